"""One incremental run: landed pages in, state and outbox out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.functions.text import as_of_text, record_key
from changewatch.operators import classify as C
from changewatch.operators import diff, extract, notify
from changewatch.operators.ordered import EVERY
from changewatch.plans.state import State, bucket_of
from changewatch.sources.landed import newest, union_sources
from changewatch.session import use_checkpoint_dir
from changewatch.sources.registry import ACTIVE, SourceSpec, owners


@dataclass
class Settings:
    """What a run may be told beside its input."""

    specs: tuple[SourceSpec, ...] = ACTIVE
    classify: diff.Classifier | None = None  # default: keyword rules
    items: Callable[[Column | str], Column] = C.items_by_rules
    buckets: int = 64
    dedupe_notified: bool = True
    hash_fallback: bool = True
    split_sources: bool = False  # key by source as well as owner and title
    every: int = EVERY


def records(pages: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """Listed records of all sources with their details, one row each.

    ``pages`` is the table of :func:`changewatch.operators.extract.parsed`, each page once.

    ``error`` says why a record cannot be processed: it is then quarantined while
    the rest goes on.
    """
    listed, described = [], []
    for spec in settings.specs:
        own = pages.filter(F.col("source") == spec.name)
        listed.append(
            extract.studies(own.filter(F.col("kind") == "listing"), spec).withColumn(
                "infer_status", F.lit(spec.infer_status)
            )
        )
        described.append(
            extract.details(own.filter(F.col("kind") == "detail"), spec, settings.hash_fallback)
        )
    studies = union_sources(listed)
    details = reduce(DataFrame.unionByName, described).withColumnRenamed("url", "source_url").withColumn("landed", F.lit(True))
    joined = studies.join(details, ["source", "source_url"], "left").join(
        owners(pages.sparkSession).select(F.col("name").alias("owner"), "owner_id"), "owner", "left"
    )
    title = F.concat("source", F.lit(":"), "title") if settings.split_sources else F.col("title")
    key = record_key(F.col("owner"), title)
    return joined.select(
        key.alias("key"),
        bucket_of(key, buckets).alias("bucket"),
        # sources in list order, then page and row
        sequence(F.col("source_ord"), F.col("pos")).alias("seq"),
        *extract.STUDY_COLUMNS[:-1],
        "infer_status",
        "description",
        "engagement_html",
        "document_links",
        "content_hash",
        F.when(F.col("owner_id").isNull(), "unknown owner")
        .when(F.col("landed").isNull(), "no detail page")
        .when(F.col("content_hash").isNull(), "unreadable page")
        .alias("error"),
    )


def sequence(source_ord: Column, pos: Column) -> Column:
    """Source order, page and row as one bigint; pages whose number does not fit were left out before."""
    return F.shiftleft(source_ord.cast("bigint"), 56) + pos


def run(
    landed: DataFrame,
    state_dir: str,
    as_of: str | None = None,
    now: datetime | None = None,
    settings: Settings | None = None,
    batch_id: int | None = None,
) -> State:
    """Process one batch of landed pages and publish the result.

    Every shared intermediate is a table of the run, so a lost executor repeats
    little and nothing is computed twice.
    """
    spark: SparkSession = landed.sparkSession
    settings = settings or Settings()
    if len(settings.specs) > 128:
        raise ValueError("over 128 sources: a record's place cannot hold them")
    use_checkpoint_dir(spark)
    classify = settings.classify or C.classify_by_rules()
    state = State(spark, state_dir, settings.buckets)
    if batch_id is not None and state.batch_id is not None and batch_id <= state.batch_id:
        return state  # this batch was published before
    no = state.run + 1
    at = F.lit((now or datetime.now(timezone.utc)).astimezone(timezone.utc)).cast("timestamp")

    # 1. extract
    landed = newest(landed)
    pages = extract.single(state.write(
        extract.parsed(landed, settings.specs), "parsed", no, by=("source", "kind")
    ))
    staged = state.write(records(pages, settings, state.buckets), "staged", no)
    good = staged.filter(F.col("error").isNull())
    touched = sorted(r.bucket for r in good.select("bucket").distinct().collect())

    # 2. compare, classify, upsert
    incoming = good.select(
        "key", "seq", "source", "owner", "title", "areas", "status", "raw_status", "source_url",
        "infer_status", "description", "document_links", "content_hash",
    )
    folded = diff.fold(incoming, state.snapshot(touched), classify, at, settings.every)
    folded = folded.drop("description", "document_links", "infer_status").withColumn(
        "bucket", bucket_of("key", state.buckets)
    )
    steps = state.write(folded, "assessments", no, by_bucket=True).filter(F.col("seq") >= 0)

    # 3. events and documents of the changed records
    changed = good.join(steps.filter("changed").select("key", "seq"), ["key", "seq"], "left_semi")
    found = state.write(
        changed.select(
            "source", F.col("key").alias("study_key"), "bucket", "seq", "source_url",
            "document_links", settings.items("engagement_html").alias("items"),
        ),
        "extracted",
        no,
    )
    items = found.select("study_key", "bucket", "seq", F.posexplode("items").alias("ord", "item")).filter(
        C.valid_item(F.col("item"))
    ).select("study_key", "bucket", "seq", "ord", "item.*")
    events, extracted = diff.split_by_type(items)
    links = found.select(
        "study_key", "bucket", "seq", F.posexplode("document_links").alias("ord", "link")
    ).select("study_key", "bucket", "seq", "ord", "link.title", "link.url", F.col("link.date").alias("published_label"))

    events = diff.events_with_fingerprint(events)
    documents = diff.merge_documents(links, extracted, ["study_key", "bucket", "seq"]).withColumn(
        "fingerprint", F.col("url")
    )
    key = ["study_key", "fingerprint"]
    new_events = state.write(
        diff.insert_if_absent(events, state.events(touched), key, ["seq", "ord"]).withColumns(
            {
                "event_ts": F.col("event_date").try_cast("timestamp"),
                "end_ts": F.col("end_date").try_cast("timestamp"),
                "inserted_at": at,
            }
        ),
        "events", no, by_bucket=True,
    )
    new_documents = state.write(
        diff.insert_if_absent(documents, state.documents(touched), key, ["seq", "ord"]).withColumn(
            "inserted_at", at
        ),
        "documents", no, by_bucket=True,
    )

    # 4. messages
    told = new_events
    if not settings.dedupe_notified:
        told = diff.newly_inserted(events, new_events, ["study_key", "fingerprint", "seq"])
    diffs = steps.withColumnsRenamed({"key": "study_key", "areas": "municipalities"})
    messages = state.write(
        notify.messages(diffs, told, new_documents, as_of_text(as_of), every=settings.every),
        "messages", no,
    )
    state.write(notify.payloads(messages, every=settings.every), "outbox", no)

    # 5. report
    state.write(
        quarantine(staged, found, at)
        .unionByName(unread_pages(pages, landed, settings.specs, at))
        .unionByName(unclassified(steps, at)),
        "quarantine", no,
    )
    state.write(metrics(staged, steps, new_events, new_documents), "metrics", no)
    state.commit(no, touched, batch_id)
    return state


def quarantine(staged: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """Records left out, and the stage and reason."""
    unusable = staged.filter(F.col("error").isNotNull()).select(
        "source", F.col("key").alias("study_key"), "seq", F.col("source_url").alias("url"),
        F.lit("record").alias("stage"), "error",
    )
    failed = found.filter(F.col("items").isNull()).select(
        "source", "study_key", "seq", F.col("source_url").alias("url"),
        F.lit("extract").alias("stage"), F.lit("extraction failed").alias("error"),
    )
    invalid = found.select("source", "study_key", "seq", "source_url", F.explode("items").alias("item")).filter(
        ~C.valid_item(F.col("item"))
    ).select(
        "source", "study_key", "seq", F.col("source_url").alias("url"),
        F.lit("item").alias("stage"),
        F.concat(F.lit("invalid type: "), F.coalesce("item.type", F.lit("none"))).alias("error"),
    )
    return unusable.unionByName(failed).unionByName(invalid).withColumn("at", at)


def unread_pages(pages: DataFrame, landed: DataFrame, specs: tuple[SourceSpec, ...], at: Column) -> DataFrame:
    """Listing pages that could not be read, and landed rows that belong to no source."""
    none = F.lit(None).cast("string").alias("study_key"), F.lit(None).cast("bigint").alias("seq")
    bad = extract.unreadable(pages, specs).filter("kind = 'listing'").select(
        "source", *none, "url", F.lit("listing").alias("stage"), F.lit("unreadable page").alias("error")
    )
    stray = extract.unknown(landed, specs).select(
        "source", *none, "url", F.lit("landing").alias("stage"),
        F.concat(F.lit("no source reads this kind: "), F.coalesce("kind", F.lit("none"))).alias("error"),
    )
    lost = extract.misnumbered(landed, specs).select(
        "source", *none, "url", F.lit("listing").alias("stage"), F.lit("bad page number").alias("error")
    )
    return bad.unionByName(stray).unionByName(lost).withColumn("at", at)


def unclassified(steps: DataFrame, at: Column) -> DataFrame:
    """Records whose classification failed; their stored scope and status stay."""
    error = F.col("classify_error") if "classify_error" in steps.columns else F.lit(None).cast("string")
    return steps.select(
        "source", F.col("key").alias("study_key"), "seq", F.col("source_url").alias("url"),
        F.lit("classify").alias("stage"), error.alias("error"),
    ).filter("error is not null").withColumn("at", at)


def metrics(staged: DataFrame, steps: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of a run: ``metric, source, study_key, category, n``."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, metric: str, by: dict[str, Column]) -> DataFrame:
        names = {n: by.get(n, none).alias(n) for n in ("source", "study_key", "category")}
        return (
            df.select(*names.values())
            .groupBy("source", "study_key", "category")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(metric).alias("metric"), "source", "study_key", "category", "n")
        )

    outcome = (
        F.when(F.col("is_new"), "new").when(F.col("changed"), "changed").otherwise("unchanged")
    )
    return reduce(
        DataFrame.unionByName,
        [
            rows(staged, "studies", {"source": F.col("source")}),
            rows(steps, "outcome", {"source": F.col("source"), "category": outcome}),
            rows(events, "new_events", {"study_key": F.col("study_key"), "category": F.col("type")}),
            rows(documents, "new_documents", {"study_key": F.col("study_key")}),
        ],
    )


