"""Comparison of incoming records with stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.functions.text import event_fingerprint
from changewatch.model import CHANGE
from changewatch.operators import dedupe
from changewatch.operators.ordered import EVERY, Scan
from changewatch.session import use_checkpoint_dir

# adds c_scope, c_reasoning and c_status to rows whose ``changed`` is true, and may add
# c_error: a record whose classification failed keeps its stored scope and status
Classifier = Callable[[DataFrame], DataFrame]


def lookup(df: DataFrame, dimension: DataFrame, on: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their dimension columns, and the rows without a match.

    One left join. No broadcast hint: Spark broadcasts the dimension if its size
    is known to be under ``spark.sql.autoBroadcastJoinThreshold``, else AQE splits
    the hot side of the shuffle.
    """
    dim = dimension.withColumn("_found", F.lit(True)).withColumnRenamed(key, on)
    joined = df.join(dim, on, "left")
    missed = joined.filter(F.col("_found").isNull()).select(*df.columns)
    return joined.filter("_found").drop("_found"), missed


def content_changed(stored_key: Column, stored_hash: Column, new_hash: Column) -> Column:
    """New, or stored with another hash; a stored NULL counts as another."""
    return stored_key.isNull() | ~stored_hash.eqNullSafe(new_hash)


def change(before: Column, after: Column, known: Column) -> Column:
    """``struct(from, to)`` when a known value differs, else NULL."""
    return F.when(
        known & ~before.eqNullSafe(after), F.struct(before.alias("from"), after.alias("to"))
    ).cast(CHANGE)


def fold(
    incoming: DataFrame,
    snapshot: DataFrame,
    classify: Classifier,
    now: Column,
    every: int = EVERY,
) -> DataFrame:
    """Apply incoming records to the snapshot in the order of ``seq``.

    Per key the stored row comes first, then the incoming rows, each compared with
    the one before it, exactly as if they were upserted one by one. ``incoming``
    has key, seq, infer_status, content_hash, the scraped status and the record's
    columns; ``snapshot`` has the stored columns.

    Result: every incoming row as a step (``seq`` >= 0) with ``changed``,
    ``is_new``, ``status_changed`` and ``scope_changed``, and untouched stored rows
    (``seq`` = -1). ``is_final`` marks the row that is the key's new stored state.
    If the classifier may fail, ``classify_error`` says where it did; the content hash
    of such a record, and of what follows it unchanged, is NULL, so that the next run
    takes it as changed and tries again.
    All steps share one shuffle by key: the stored rows join by union.
    """
    kept = ["key", "title", "owner", "areas", "source_url", "raw_status", "content_hash"]
    stored = snapshot.select(
        *kept,
        F.lit(-1).cast("bigint").alias("seq"),
        F.col("status").alias("_status"),
        F.struct("scope", F.coalesce("scope_reasoning", F.lit("")).alias("reasoning")).alias("_scope"),
        "scope_reasoning",
        "inserted_at",
        "last_seen_at",
        "updated_at",
    )
    rows = incoming.withColumnRenamed("status", "_scraped").unionByName(
        stored, allowMissingColumns=True
    )
    scan = Scan(rows, ["key"], "seq", every)
    is_stored = F.col("seq") < 0

    seen = scan.previous(scan.df, ["content_hash"], "_prev")
    seen = seen.withColumn(
        "changed",
        ~is_stored
        & content_changed(F.col("_prev"), F.col("_prev.content_hash"), F.col("content_hash")),
    )
    judged = classify(seen)
    may_fail = "c_error" in judged.columns
    if not may_fail:
        judged = judged.withColumn("c_error", F.lit(None).cast("string"))
    if scan.hot:
        # blocks read this twice; a costly classifier must run once
        use_checkpoint_dir(judged.sparkSession)
        judged = judged.checkpoint()

    state = scan.latest(
        judged,
        {
            "_now_scope": F.when(is_stored, F.col("_scope")).when(
                F.col("changed") & F.col("c_error").isNull(),
                F.struct(F.col("c_scope").alias("scope"), F.col("c_reasoning").alias("reasoning")),
            ),
            "status": F.when(is_stored, F.col("_status"))
            .when(~F.col("infer_status"), F.col("_scraped"))
            .when(F.col("changed") & F.col("c_error").isNull(), F.coalesce("c_status", "_scraped")),
            "_first_stored": F.when(is_stored, F.col("inserted_at")),
            "_untold": F.when(is_stored, False).when(F.col("changed"), F.col("c_error").isNotNull()),
        },
    )
    state = state.withColumns(
        {
            # a new record of which nothing is known yet
            "scope": F.coalesce("_now_scope.scope", F.when(F.col("_untold"), F.lit("unclassified"))),
            "status": F.coalesce("status", F.when(F.col("_untold"), F.col("_scraped"))),
            "content_hash": F.when(~F.coalesce("_untold", F.lit(False)), F.col("content_hash")),
        }
    )
    compared = scan.is_last(scan.previous(state, ["status", "scope"], "_before"), "is_final")

    known = ~is_stored & F.col("_before").isNotNull()
    return scan.done(
        compared.withColumns(
            {
                "is_new": ~is_stored & F.col("_before").isNull(),
                "status_changed": change(F.col("_before.status"), F.col("status"), known),
                "scope_changed": change(F.col("_before.scope"), F.col("scope"), known),
                "scope_reasoning": F.when(is_stored, F.col("scope_reasoning")).otherwise(
                    F.col("_now_scope.reasoning")
                ),
                "inserted_at": F.coalesce("_first_stored", now),
                "last_seen_at": F.when(is_stored, F.col("last_seen_at")).otherwise(now),
                "updated_at": F.when(is_stored, F.col("updated_at")).otherwise(now),
                **({"classify_error": F.col("c_error")} if may_fail else {}),
            }
        ).drop(
            "_prev", "_before", "_scope", "_status", "_scraped", "_now_scope", "_first_stored",
            "c_scope", "c_reasoning", "c_status", "c_error", "_untold",
        )
    ).filter((F.col("seq") >= 0) | F.col("is_final"))


def insert_if_absent(
    incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Incoming rows whose key is not stored: the first of each key.

    The incoming side is reduced to one row per key before the anti join, so
    neither side of the join has a hot key.
    """
    return dedupe.first_seen(incoming, keys, order).join(
        stored.select(*keys), keys, "left_anti"
    )


def newly_inserted(incoming: DataFrame, inserted: DataFrame, keys: list[str]) -> DataFrame:
    """All incoming rows of the inserted keys, repeats included."""
    return incoming.join(inserted.select(*keys), keys, "left_semi")


def events_with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "fingerprint", event_fingerprint(F.col("type"), F.col("url"), F.col("event_date"))
    )


def split_by_type(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted items as (events, documents)."""
    return items.filter(F.col("type") != "document"), items.filter(F.col("type") == "document")


def merge_documents(links: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Structured links first; extracted documents fill in unseen, non-empty urls.

    ``links``: keys, url, title, published_label, ord. ``extracted``: keys, url,
    notes, event_date, ord. Of repeated links the last one's values count at the
    first one's place; of repeated extracted documents the first.
    """
    values = F.struct("title", "published_label")
    both = links.select(
        *keys, "url", values.alias("_v"), F.lit(0).alias("_rank"), F.col("ord").cast("bigint").alias("ord")
    ).unionByName(
        extracted.filter(F.col("url") != "").select(
            *keys,
            "url",
            F.struct(
                F.coalesce("notes", "url").alias("title"), F.col("event_date").alias("published_label")
            ).alias("_v"),
            F.lit(1).alias("_rank"),
            F.col("ord").cast("bigint").alias("ord"),
        )
    )
    merged = both.groupBy(*keys, "url").agg(
        F.max_by("_v", F.when(F.col("_rank") == 0, F.col("ord"))).alias("_link"),
        F.min_by("_v", F.when(F.col("_rank") == 1, F.col("ord"))).alias("_extracted"),
        F.min(F.struct("_rank", "ord")).alias("_pos"),
    )
    chosen = F.coalesce("_link", "_extracted")
    return merged.select(
        *keys,
        "url",
        chosen["title"].alias("title"),
        chosen["published_label"].alias("published_label"),
        # links before extracted documents, each in their own order
        (F.shiftleft(F.col("_pos._rank").cast("bigint"), 48) + F.col("_pos.ord")).alias("ord"),
    )


def orphans(child: DataFrame, parent: DataFrame, on: str, key: str) -> DataFrame:
    """Child keys without a parent, with their row counts.

    Children are counted per key before the join.
    """
    counts = child.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(parent.select(F.col(key).alias(on)), on, "left_anti")


def without_orphans(child: DataFrame, parent: DataFrame, on: str, key: str) -> DataFrame:
    """Children of existing parents only (what a cascading delete leaves)."""
    return child.join(parent.select(F.col(key).alias(on)), on, "left_semi")
