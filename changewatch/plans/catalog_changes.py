"""Queries over comparison with stored state, classification, quality and messages."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.functions import text as T
from changewatch.model import SNAPSHOT
from changewatch.operators import classify as C
from changewatch.operators import diff, notify, quality
from changewatch.operators.classify import Keyword, classify_by_function
from changewatch.plans.catalog import ROWS_PER_PAGE, query, spread, table
from changewatch.plans.catalog_extract import titled
from changewatch.plans.run import Settings, run
from changewatch.plans.state import QUARANTINE, State
from changewatch.session import use_checkpoint_dir
from changewatch.sources.registry import OAKVILLE

STATUS_OF = ("on_going", "deferred", "completed", "unknown")
SCOPE_OF = ("in_scope", "out_of_scope", "unclassified")
# word ends as white space: engines disagree on \b beside non-ASCII letters
RULES = (
    Keyword("in_scope", r"(?:^|\s)(?:the|with)\s", "English function words."),
    Keyword("out_of_scope", r"(?:^|\s)(?:les|que|der|und)\s", "French or German function words."),
)
STATUS_RULES = (
    Keyword("completed", r"tion\s", "Ends in tion."),
    Keyword("deferred", r"\sla\s", "Has la."),
    Keyword("on_going", r"\s(?:de|en)\s", "Has de or en."),
)
LATER = "2024-02-01 00:00:00"
EARLIER = "2024-01-01 00:00:00"


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], n: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({n}) % {len(values)} {cases} END"


# --- records made of documents: key = (source, first line) ------------------------------


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as incoming records in doc_id order; keys may repeat."""
    docs = table(spark, sf, "documents")
    title = F.regexp_extract("text", "^[^\\n]*", 0)
    return docs.select(
        T.record_key(F.col("source"), title).alias("key"),
        F.col("doc_id").alias("seq"),
        F.col("source").alias("owner"),
        title.alias("title"),
        F.array("lang").alias("areas"),
        F.concat(F.lit("https://www.example.ca/d/"), "doc_id").alias("source_url"),
        F.lit("").alias("raw_status"),
        pick(STATUS_OF, F.col("doc_id") + 1).alias("status"),
        (F.col("n_chars") % 2 == 0).alias("infer_status"),
        F.col("text").alias("description"),
        F.lit(None).cast("array<struct<title:string,url:string,date:string>>").alias("document_links"),
        T.sha256_hex("text").alias("content_hash"),
    )


def stored_records(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot: the first document of most keys, some hashes altered or missing."""
    docs = document_records(spark, sf)
    n = F.col("_r.seq")
    first = docs.groupBy("key").agg(
        F.min_by(F.struct("seq", "owner", "title", "areas", "source_url", "raw_status", "content_hash"), "seq").alias("_r")
    )
    stamp = F.lit(EARLIER).cast("timestamp")
    columns = {
        "key": F.col("key"), "title": F.col("_r.title"), "owner": F.col("_r.owner"), "areas": F.col("_r.areas"),
        "source_url": F.col("_r.source_url"), "status": pick(STATUS_OF, n), "raw_status": F.col("_r.raw_status"),
        "scope": pick(SCOPE_OF, n), "scope_reasoning": F.when(n % 5 != 0, F.lit("stored")),
        "content_hash": F.when(n % 7 == 1, F.lit("altered")).when(n % 7 != 2, F.col("_r.content_hash")),
        "last_seen_at": stamp, "inserted_at": stamp, "updated_at": stamp,
    }
    names = [c.split()[0] for c in SNAPSHOT.split(", ")]
    return first.filter(n % 3 != 0).select(*(columns[c].alias(c) for c in names))


def classify(df: DataFrame) -> DataFrame:
    return C.classify_by_rules(RULES, STATUS_RULES)(df)


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return diff.fold(document_records(spark, sf), stored_records(spark, sf), classify, F.lit(LATER).cast("timestamp"))


_WORDS = r"(?is)(?:^|\s)(?:the|with)\s"
_FOREIGN = r"(?is)(?:^|\s)(?:les|que|der|und)\s"
_BODY = "(title || chr(10) || left(text, 3000))"
SQL_SCOPE = (
    f"CASE WHEN regexp_matches({_BODY}, '{_WORDS}') THEN 'in_scope' WHEN regexp_matches({_BODY}, '{_FOREIGN}') THEN 'out_of_scope' ELSE 'unclassified' END"
)
SQL_REASON = (
    f"CASE WHEN regexp_matches({_BODY}, '{_WORDS}') THEN 'English function words.' WHEN regexp_matches({_BODY}, '{_FOREIGN}')"
    " THEN 'French or German function words.' ELSE 'No rule matched.' END"
)
SQL_STATUS = (
    f"CASE WHEN regexp_matches({_BODY}, '(?is)tion\\s') THEN 'completed' WHEN regexp_matches({_BODY}, '(?is)\\sla\\s') THEN 'deferred'"
    f" WHEN regexp_matches({_BODY}, '(?is)\\s(?:de|en)\\s') THEN 'on_going' ELSE 'unknown' END"
)

# The sequential semantics as SQL windows over stored (seq -1) and incoming rows.
SQL_FOLD = f"""
    docs AS (SELECT *, regexp_extract(text, '^[^\\n]*') AS title FROM documents),
    firsts AS (SELECT source, title, min(doc_id) AS n FROM docs GROUP BY 1, 2),
    stored AS (SELECT f.source, f.title, -1 AS seq, {sql_pick(STATUS_OF, "n")} AS status, {sql_pick(SCOPE_OF, "n")} AS scope,
                      CASE WHEN n % 5 <> 0 THEN 'stored' END AS reasoning, CAST(NULL AS BOOLEAN) AS infer,
                      CASE WHEN n % 7 = 1 THEN 'altered' WHEN n % 7 <> 2 THEN sha256(d.text) END AS hash,
                      CAST(NULL AS VARCHAR) AS c_scope, CAST(NULL AS VARCHAR) AS c_reason, CAST(NULL AS VARCHAR) AS c_status
               FROM firsts f JOIN docs d ON d.doc_id = f.n WHERE n % 3 <> 0),
    incoming AS (SELECT source, title, doc_id AS seq, {sql_pick(STATUS_OF, "doc_id + 1")} AS status, NULL, NULL, n_chars % 2 = 0, sha256(text),
                        {SQL_SCOPE}, {SQL_REASON}, {SQL_STATUS} FROM docs),
    rows AS (SELECT * FROM stored UNION ALL SELECT * FROM incoming),
    marked AS (SELECT *, seq >= 0 AND (row_number() OVER w = 1 OR hash IS DISTINCT FROM lag(hash) OVER w) AS changed
               FROM rows WINDOW w AS (PARTITION BY source, title ORDER BY seq)),
    filled AS (SELECT *,
        last_value(CASE WHEN seq < 0 THEN scope WHEN changed THEN c_scope END IGNORE NULLS) OVER w AS now_scope,
        last_value(CASE WHEN seq < 0 THEN coalesce(reasoning, '') WHEN changed THEN c_reason END IGNORE NULLS) OVER w AS now_reason,
        last_value(CASE WHEN seq < 0 THEN status WHEN NOT infer THEN status WHEN changed THEN c_status END IGNORE NULLS) OVER w AS now_status
        FROM marked WINDOW w AS (PARTITION BY source, title ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    steps AS (SELECT *, lag(now_status) OVER w AS old_status, lag(now_scope) OVER w AS old_scope, row_number() OVER w = 1 AS first_row,
                     lead(seq) OVER w IS NULL AS is_final
              FROM filled WINDOW w AS (PARTITION BY source, title ORDER BY seq))"""


@query(
    f"""WITH {SQL_FOLD} SELECT seq, source AS owner, title, changed, first_row AS is_new, now_status AS status, now_scope AS scope,
        now_reason AS scope_reasoning, is_final,
        CASE WHEN old_status <> now_status THEN old_status || '>' || now_status END AS status_change,
        CASE WHEN old_scope <> now_scope THEN old_scope || '>' || now_scope END AS scope_change FROM steps WHERE seq >= 0"""
)
def fold_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every incoming record compared with the one before it, repeats of a key included."""

    def shown(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(f"{c}.from", F.lit(">"), f"{c}.to"))

    return folded(spark, sf).filter(F.col("seq") >= 0).select(
        "seq", "owner", "title", "changed", "is_new", "status", "scope", "scope_reasoning", "is_final",
        shown("status_changed").alias("status_change"), shown("scope_changed").alias("scope_change"),
    )


@query(
    f"""WITH {SQL_FOLD}, stamps AS (SELECT source, title, bool_or(seq < 0) AS was_stored FROM steps GROUP BY 1, 2)
        SELECT source AS owner, title, now_status AS status, now_scope AS scope,
        CASE WHEN seq < 0 THEN reasoning ELSE now_reason END AS scope_reasoning, hash AS content_hash,
        CASE WHEN was_stored THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{LATER}' END AS inserted_at,
        CASE WHEN seq < 0 THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{LATER}' END AS updated_at
        FROM steps JOIN stamps USING (source, title) WHERE is_final"""
)
def fold_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The stored state after the fold."""
    return folded(spark, sf).filter("is_final").select(
        "owner", "title", "status", "scope", "scope_reasoning", "content_hash",
        *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("inserted_at", "updated_at")),
    )


_PAGE_ROWS = """h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS owner, html,
       trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'),
       '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages)"""


@query(
    f"""WITH {_PAGE_ROWS}, inc AS (SELECT owner, title, arg_min(sha256(html), page_id) AS content_hash, min(page_id) AS page_id FROM h GROUP BY 1, 2),
        st AS (SELECT owner, title, CASE WHEN page_id % 4 = 1 THEN 'altered' ELSE content_hash END AS stored_hash FROM inc WHERE page_id % 2 = 1)
        SELECT inc.owner, inc.title, page_id, content_hash, stored_hash IS NULL AS is_new,
               stored_hash IS DISTINCT FROM content_hash AS content_changed
        FROM inc LEFT JOIN st USING (owner, title)"""
)
def page_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages merged by (host, title) and compared with a stored half."""
    rows = titled(spark, sf).select(
        F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("owner"), "title", "page_id", T.sha256_hex("html").alias("content_hash")
    )
    merged = rows.groupBy("owner", "title").agg(
        F.min("page_id").alias("page_id"), F.min_by("content_hash", "page_id").alias("content_hash")
    )
    stored = merged.filter(F.col("page_id") % 2 == 1).select(
        "owner", "title",
        F.when(F.col("page_id") % 4 == 1, F.lit("altered")).otherwise(F.col("content_hash")).alias("stored_hash"),
        F.lit(True).alias("known"),
    )
    return merged.join(stored, ["owner", "title"], "left").select(
        "owner", "title", "page_id", "content_hash", F.col("known").isNull().alias("is_new"),
        diff.content_changed(F.col("known"), F.col("stored_hash"), F.col("content_hash")).alias("content_changed"),
    )


# --- events: keys (user, type and hour) ---------------------------------------------------

EVENT_TYPE = "CASE event_type WHEN 'view' THEN 'open_house' WHEN 'click' THEN 'comment_deadline' WHEN 'purchase' THEN 'hearing' WHEN 'signup' THEN 'document' ELSE 'party' END"
_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def event_items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as extracted items of a study per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("study_key"), F.lit(1).cast("bigint").alias("seq"), F.col("event_id").alias("ord"),
        F.expr(EVENT_TYPE).alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("event_date"),
        F.when(F.col("event_id") % 3 == 0, F.date_format(F.col("ts") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd")).alias("end_date"),
        F.when(F.col("event_id") % 4 == 0, F.lit("Online")).alias("location"),
        F.when(F.col("event_id") % 5 > 1, F.concat(F.lit("https://www.example.ca/e/"), F.col("event_id") % 50))
        .when(F.col("event_id") % 5 == 1, F.lit("")).alias("url"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Note "), "event_id")).alias("notes"),
        "ts",
    )


SQL_ITEMS = f"""items AS (SELECT CAST(user_id AS VARCHAR) AS study_key, event_id AS ord, {EVENT_TYPE} AS type, strftime(ts, '%Y-%m-%dT%H:00') AS event_date,
       CASE WHEN event_id % 3 = 0 THEN strftime(ts + INTERVAL 3 DAYS, '%Y-%m-%d') END AS end_date, CASE WHEN event_id % 4 = 0 THEN 'Online' END AS location,
       CASE WHEN event_id % 5 > 1 THEN 'https://www.example.ca/e/' || (event_id % 50) WHEN event_id % 5 = 1 THEN '' END AS url,
       CASE WHEN event_id % 2 = 0 THEN 'Note ' || event_id END AS notes, ts FROM events),
    marked AS (SELECT *, type || ':' || coalesce(url, '') || ':' || coalesce(event_date, '') AS fingerprint FROM items)"""
SQL_NEW_EVENTS = f"""{SQL_ITEMS},
    fresh AS (SELECT * FROM marked WHERE type IN ('open_house', 'comment_deadline', 'hearing') AND ts >= {_SPLIT}),
    old AS (SELECT DISTINCT study_key, fingerprint FROM marked WHERE type IN ('open_house', 'comment_deadline', 'hearing') AND ts < {_SPLIT} + INTERVAL 2 DAYS AND ord % 2 = 0),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_key, fingerprint ORDER BY ord) AS rn FROM fresh)
            WHERE rn = 1 AND (study_key, fingerprint) NOT IN (SELECT study_key, fingerprint FROM old))"""


def incoming_and_stored_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    valid, _ = C.split_valid(event_items(spark, sf))
    events = diff.events_with_fingerprint(valid)
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    stored = events.filter((ts < split + F.expr("INTERVAL 2 DAYS")) & (F.col("ord") % 2 == 0))
    return events.filter(ts >= split), stored.select("study_key", "fingerprint").distinct()


def new_event_frame(spark: SparkSession, sf: str) -> DataFrame:
    incoming, stored = incoming_and_stored_events(spark, sf)
    return diff.insert_if_absent(incoming, stored, ["study_key", "fingerprint"], ["ord"])


@query(f"WITH {SQL_NEW_EVENTS} SELECT study_key, fingerprint, ord, type, event_date, end_date, location, url, notes FROM new")
def new_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose fingerprint is not stored, the first of each."""
    return new_event_frame(spark, sf).select(
        "study_key", "fingerprint", "ord", "type", "event_date", "end_date", "location", "url", "notes"
    )


@query(f"WITH {SQL_NEW_EVENTS} SELECT f.study_key, f.ord FROM fresh f JOIN new n USING (study_key, fingerprint)")
def new_event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All incoming rows of newly inserted fingerprints, repeats included."""
    incoming, stored = incoming_and_stored_events(spark, sf)
    inserted = diff.insert_if_absent(incoming, stored, ["study_key", "fingerprint"], ["ord"])
    return diff.newly_inserted(incoming, inserted, ["study_key", "fingerprint"]).select("study_key", "ord")


@query(f"WITH {SQL_NEW_EVENTS} SELECT study_key, type, count(*) AS n FROM new GROUP BY 1, 2")
def new_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return new_event_frame(spark, sf).groupBy("study_key", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SQL_ITEMS} SELECT study_key, ord, type = 'document' AS is_document, type NOT IN ('open_house', 'comment_deadline', 'hearing', 'document') AS invalid
        FROM items"""
)
def split_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items split into events, documents and invalid ones."""
    events, documents = diff.split_by_type(event_items(spark, sf))
    valid, invalid = C.split_valid(events)

    def marked(df: DataFrame, document: bool, bad: bool) -> DataFrame:
        return df.select("study_key", "ord", F.lit(document).alias("is_document"), F.lit(bad).alias("invalid"))

    return marked(valid, False, False).unionByName(marked(invalid, False, True)).unionByName(marked(documents, True, False))


SQL_DOCUMENTS = f"""{SQL_ITEMS},
    links AS (SELECT study_key, url, notes AS title, location AS label, 0 AS rank, ord FROM items WHERE type = 'open_house' AND url <> ''),
    ext AS (SELECT study_key, url, coalesce(notes, url) AS title, event_date AS label, 1 AS rank, ord FROM items WHERE type = 'document' AND url <> ''),
    merged AS (SELECT study_key, url,
        CASE WHEN count(*) FILTER (WHERE rank = 0) > 0 THEN first(title ORDER BY ord DESC) FILTER (WHERE rank = 0) ELSE first(title ORDER BY ord) FILTER (WHERE rank = 1) END AS title,
        CASE WHEN count(*) FILTER (WHERE rank = 0) > 0 THEN first(label ORDER BY ord DESC) FILTER (WHERE rank = 0) ELSE first(label ORDER BY ord) FILTER (WHERE rank = 1) END AS published_label,
        min(rank) AS rank, coalesce(min(ord) FILTER (WHERE rank = 0), min(ord)) AS pos
        FROM (SELECT * FROM links UNION ALL SELECT * FROM ext) GROUP BY 1, 2)"""


def merged_document_frame(spark: SparkSession, sf: str) -> DataFrame:
    items = event_items(spark, sf)
    _, extracted = diff.split_by_type(items)
    links = items.filter((F.col("type") == "open_house") & (F.col("url") != "")).select(
        "study_key", "seq", "url", F.col("notes").alias("title"), F.col("location").alias("published_label"), "ord"
    )
    return diff.merge_documents(links, extracted, ["study_key", "seq"])


@query(f"WITH {SQL_DOCUMENTS} SELECT study_key, url, title, published_label, rank * 281474976710656 + pos AS ord FROM merged")
def merged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Structured links before extracted documents, by URL."""
    return merged_document_frame(spark, sf).drop("seq")


@query(
    f"""WITH {SQL_DOCUMENTS} SELECT study_key, url, title, published_label FROM merged
        WHERE (study_key, url) NOT IN (SELECT study_key, url FROM items WHERE type = 'hearing' AND url IS NOT NULL)"""
)
def new_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Merged documents that are not stored yet."""
    stored = event_items(spark, sf).filter((F.col("type") == "hearing") & F.col("url").isNotNull()).select("study_key", "url").distinct()
    return diff.insert_if_absent(merged_document_frame(spark, sf), stored, ["study_key", "url"], ["ord"]).select(
        "study_key", "url", "title", "published_label"
    )


SQL_LABEL = "'[' || coalesce(title, url) || '](' || url || ')' || CASE WHEN published_label <> '' THEN ' — ' || published_label ELSE '' END"


@query(
    f"""WITH {SQL_DOCUMENTS} SELECT study_key, string_agg({SQL_LABEL}, chr(10) ORDER BY rank, pos) AS documents
        FROM merged GROUP BY study_key"""
)
def listed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A study's documents as one text, in order."""
    docs = merged_document_frame(spark, sf).withColumn("title", F.coalesce("title", "url"))
    return notify.listed_documents(docs, ["study_key"])


SQL_ONE = """CASE WHEN {d} IS NULL THEN NULL WHEN contains({d}, 'T') THEN strftime(CAST({d} AS TIMESTAMP), '%B %-d, %Y at %-I:%M ') ||
    CASE WHEN hour(CAST({d} AS TIMESTAMP)) < 12 THEN 'a.m.' ELSE 'p.m.' END ELSE strftime(CAST({d} AS TIMESTAMP), '%B %-d, %Y') END"""
SQL_RANGE = (
    "CASE WHEN event_date IS NULL AND end_date IS NULL THEN 'Date TBD' WHEN end_date IS NULL THEN " + SQL_ONE.format(d="event_date")
    + " WHEN event_date IS NULL THEN " + SQL_ONE.format(d="end_date") + " ELSE " + SQL_ONE.format(d="event_date")
    + " || ' – ' || " + SQL_ONE.format(d="(end_date || 'T23:59')") + " END"
)
SQL_TYPE_LABEL = "CASE type WHEN 'open_house' THEN 'Open House / PIC' WHEN 'comment_deadline' THEN 'Comment Deadline' WHEN 'hearing' THEN 'Public Hearing' ELSE type END"


@query(
    f"""WITH {SQL_ITEMS}, dated AS (SELECT * REPLACE (CASE WHEN ord % 7 = 0 THEN NULL ELSE event_date END AS event_date) FROM marked)
        SELECT ord, fingerprint, {SQL_TYPE_LABEL} AS type_label, {SQL_RANGE} AS dates,
        '[' || type || '](' || coalesce(url, '-') || ')' || CASE WHEN notes <> '' THEN ' — ' || notes ELSE '' END AS link,
        coalesce(location || ', ', '') || type AS areas,
        CASE WHEN end_date IS NOT NULL THEN end_date >= '2024-01-16' WHEN event_date IS NOT NULL THEN event_date >= '2024-01-16' ELSE true END AS upcoming
        FROM dated"""
)
def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints, labels, date ranges and whether an event lies ahead."""
    items = diff.events_with_fingerprint(event_items(spark, sf)).withColumn(
        "event_date", F.when(F.col("ord") % 7 != 0, F.col("event_date"))
    )
    return items.select(
        "ord", "fingerprint", T.format_event_type("type").alias("type_label"), T.format_date_range("event_date", "end_date").alias("dates"),
        T.document_label(F.col("type"), F.coalesce("url", F.lit("-")), F.col("notes")).alias("link"),
        T.join_areas(F.array_compact(F.array("location", "type"))).alias("areas"),
        T.is_upcoming(F.col("event_date"), F.col("end_date"), F.lit("on_going"), T.as_of_text("2024-01-16")).alias("upcoming"),
    )


# --- lookups and constraints ----------------------------------------------------------------


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 5 <> 0")
def owner_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their nation, looked up in a reduced dimension."""
    found, _ = diff.lookup(table(spark, sf, "supplier"), _nations(spark, sf), "s_nationkey", "n_nationkey")
    return found.select("s_suppkey", "s_name", "n_name")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey % 5 = 0")
def owner_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose nation is unknown: for quarantine."""
    _, missed = diff.lookup(table(spark, sf, "supplier"), _nations(spark, sf), "s_nationkey", "n_nationkey")
    return missed.select("s_suppkey", "s_nationkey")


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").filter(F.col("n_nationkey") % 5 != 0).select("n_nationkey", "n_name")


@query(
    """SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 1)
       WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) GROUP BY doc_id"""
)
def orphan_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    child = labels.select("doc_id").unionByName(labels.filter("quality = 1").select("doc_id"))
    return diff.orphans(child, table(spark, sf, "documents").filter(F.col("doc_id") % 7 != 0), "doc_id", "doc_id")


@query("SELECT l.doc_id, quality, toxic FROM labels l WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def labels_without_orphans(spark: SparkSession, sf: str) -> DataFrame:
    parent = table(spark, sf, "documents").filter(F.col("doc_id") % 7 != 0)
    return diff.without_orphans(table(spark, sf, "labels"), parent, "doc_id", "doc_id")


@query(
    """WITH d AS (SELECT *, nullif(regexp_extract(text, '^[^\\n]*'), '') AS title, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS src FROM documents)
       SELECT 'src is null' AS "check", count(*) FILTER (WHERE src IS NULL) AS n FROM d
       UNION ALL SELECT 'title is null', count(*) FILTER (WHERE title IS NULL) FROM d
       UNION ALL SELECT 'lang not in enum', count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) FROM d
       UNION ALL SELECT 'source, title not unique', count(*) FROM (SELECT 1 FROM d GROUP BY source, title HAVING count(*) > 1)"""
)
def constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumns(
        {"title": T.blank_to_null(F.regexp_extract("text", "^[^\\n]*", 0)), "src": F.when(F.col("doc_id") % 9 != 0, F.col("source"))}
    )
    return quality.violations(docs, ("src", "title"), {"lang": ("en", "fr")}, (("source", "title"),))


@query(
    f"""WITH {SQL_ITEMS} SELECT study_key, coalesce(url, '') AS url, notes AS title, CAST(NULL AS VARCHAR) AS published_label,
        coalesce(url, fingerprint) AS fingerprint FROM marked WHERE type = 'document'
        UNION ALL SELECT study_key, 'kept', notes, NULL, fingerprint FROM marked WHERE type <> 'document'"""
)
def split_table(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed table split into documents and events."""
    events, documents = quality.split_documents(diff.events_with_fingerprint(event_items(spark, sf)))
    kept = events.select(
        "study_key", F.lit("kept").alias("url"), F.col("notes").alias("title"), F.lit(None).cast("string").alias("published_label"), "fingerprint"
    )
    return documents.unionByName(kept)


@query(
    f"""WITH {SQL_ITEMS} SELECT ord, '' AS fingerprint, coalesce(location, 'unknown') AS location, CAST(NULL AS VARCHAR) AS content_hash
        FROM items WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"""
)
def events_between(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a time range, columns missing from an older schema added."""
    events = quality.between_dates(event_items(spark, sf), "2024-01-10", "2024-01-20", "ts")
    evolved = quality.with_defaults(
        events, {"fingerprint": F.lit(""), "location": F.lit("unknown"), "content_hash": F.lit(None).cast("string")}
    )
    return evolved.select("ord", "fingerprint", "location", "content_hash")


# --- classification -------------------------------------------------------------------------


@query(
    f"""WITH docs AS (SELECT *, regexp_extract(text, '^[^\\n]*') AS title FROM documents)
        SELECT doc_id, {SQL_SCOPE} AS scope, {SQL_REASON} AS reason, CASE WHEN n_chars % 2 = 0 THEN {SQL_STATUS} END AS status, true AS valid FROM docs"""
)
def classified_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Scope, and status where it has to be inferred, by rule tables."""
    judged = classify(document_records(spark, sf).withColumn("changed", F.lit(True)))
    return judged.select(
        F.col("seq").alias("doc_id"), F.col("c_scope").alias("scope"), F.col("c_reasoning").alias("reason"), F.col("c_status").alias("status"),
        C.valid_classification(F.col("c_scope"), F.col("c_reasoning")).alias("valid"),
    )


@query(
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'open_house' WHEN 'click' THEN 'comment_deadline' WHEN 'purchase' THEN 'hearing' END AS type,
                  strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M') AS moment, strftime(ts + INTERVAL 5 DAYS, '%Y-%m-%d') AS later, user_id
                  FROM events WHERE event_type IN ('view', 'click', 'purchase'))
       SELECT event_id, type, CASE WHEN type = 'comment_deadline' AND event_id % 2 = 0 THEN NULL WHEN type = 'comment_deadline' THEN day ELSE moment END AS event_date,
              CASE WHEN type = 'comment_deadline' AND event_id % 2 = 0 THEN day WHEN type = 'comment_deadline' THEN later END AS end_date,
              CASE WHEN type = 'open_house' THEN 'Hall ' || user_id WHEN type = 'hearing' THEN 'Online' END AS location,
              CASE WHEN type = 'open_house' THEN 'https://www.example.ca/e/' || event_id END AS url FROM e"""
)
def dated_events(spark: SparkSession, sf: str) -> DataFrame:
    """Dated events found in block HTML; each event row is told as a sentence."""
    day, kind = F.date_format("ts", "MMMM d, yyyy"), F.col("event_type")
    clock = F.concat(F.date_format("ts", "h:mm "), F.when(F.hour("ts") < 12, "a.m.").otherwise("p.m."))
    sentence = (
        F.when(
            kind == "view",
            F.concat(F.lit("An open house will be held on "), day, F.lit(" at "), clock, F.lit(" at Hall "), "user_id",
                     F.lit('. See <a href="https://www.example.ca/e/'), "event_id", F.lit('">the notice</a>.')),
        )
        .when(
            (kind == "click") & (F.col("event_id") % 2 == 0), F.concat(F.lit("Comments are due by "), day, F.lit("."))
        )
        .when(
            kind == "click",
            F.concat(F.lit("Comment period: "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" to "),
                     F.date_format(F.col("ts") + F.expr("INTERVAL 5 DAYS"), "yyyy-MM-dd")),
        )
        .when(kind == "purchase", F.concat(F.lit("The public hearing is online on "), day, F.lit(", "), clock))
        .when(kind == "signup", F.concat(F.lit("Signed up on "), day))
    )
    html = F.concat(F.lit("<p>Some words. Others follow!</p><p>"), F.regexp_replace(sentence, r"\. See (.*)\.$", " $1."), F.lit("</p>"))
    pages = spread(table(spark, sf, "events"), "event_id").select("event_id", html.alias("html"))
    return pages.select("event_id", F.explode(C.items_by_rules("html")).alias("i")).select(
        "event_id", "i.type", "i.event_date", "i.end_date", "i.location", "i.url"
    )


@query(
    """WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M') AS moment,
                  strftime(ts + INTERVAL 5 DAYS, '%Y-%m-%d') AS later, strftime(ts + INTERVAL 9 DAYS, '%Y-%m-%d') AS last, event_id % 2 = 0 AS even FROM events)
       SELECT event_id, 'open_house' AS type, moment AS event_date, CAST(NULL AS VARCHAR) AS end_date, 'Hall ' || user_id AS location,
              'https://www.example.ca/e?n=' || event_id || '&x' AS url FROM e
       UNION ALL SELECT event_id, 'open_house', later, NULL, NULL, NULL FROM e WHERE even
       UNION ALL SELECT event_id, 'comment_deadline', CASE WHEN even THEN later END, last, NULL, NULL FROM e
       UNION ALL SELECT event_id, 'hearing', last, NULL, 'Online', NULL FROM e WHERE NOT even"""
)
def dated_event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Several events in the lines of one block: line breaks, ranges, inner tags and entities."""
    day = lambda n: F.date_format(F.col("ts") + F.expr(f"INTERVAL {n} DAYS"), "MMMM d, yyyy")
    clock = F.concat(F.date_format("ts", "h:mm "), F.when(F.hour("ts") < 12, "a.m.").otherwise("p.m."))
    even = F.col("event_id") % 2 == 0
    first = F.concat(F.lit('<p>Open&nbsp;<b>house</b>: '), day(0), F.lit(", "), clock, F.lit(" at Hall "), "user_id",
                     F.lit(', <a href="https://www.example.ca/e?n='), "event_id", F.lit('&amp;x">map</a>'))
    html = F.concat(
        first,
        F.when(even, F.concat(F.lit("<br>Open house <i>again</i>: "), day(5), F.lit("<br/>Comments from&#32;"), day(5), F.lit(" &ndash; "), day(9)))
        .otherwise(F.concat(F.lit("<br />Written comments<br>are due on "), day(9), F.lit("<BR>The public hearing is online: "), day(9))),
        F.lit("<br>See the notice</p>"),
    )
    pages = spread(table(spark, sf, "events"), "event_id").select("event_id", html.alias("html"))
    return pages.select("event_id", F.explode(C.items_by_rules("html")).alias("i")).select(
        "event_id", "i.type", "i.event_date", "i.end_date", "i.location", "i.url"
    )


# --- messages -------------------------------------------------------------------------------

AS_OF = "2024-01-16"


def message_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Differences of the fold as studies; events and documents of the users of the same number.

    The rules read the differences three times, so they are computed once, into the
    checkpoint folder (a run reads them from its own table).
    """
    use_checkpoint_dir(spark)
    diffs = folded(spark, sf).filter(F.col("seq") >= 0).select(
        F.col("seq").cast("string").alias("study_key"), F.lit(1).cast("bigint").alias("seq"), F.col("areas").alias("municipalities"),
        "title", "source_url", "status", "scope", "scope_reasoning", "is_new", "status_changed", "scope_changed",
    ).checkpoint()
    docs = merged_document_frame(spark, sf).withColumn("title", F.coalesce("title", "url"))
    return diffs, new_event_frame(spark, sf), docs


SQL_MESSAGES = f"""{SQL_FOLD.replace("marked AS", "hashed AS").replace("FROM marked", "FROM hashed")}, {SQL_NEW_EVENTS}, {SQL_DOCUMENTS.split("documents_", 1)[0].replace(SQL_ITEMS + ",", "", 1)},
    d AS (SELECT CAST(seq AS VARCHAR) AS study_key, lang AS municipalities, s.title, 'https://www.example.ca/d/' || doc_id AS source_url, now_status AS status,
                 now_scope AS scope, now_reason AS reason, first_row AS is_new, CASE WHEN old_status <> now_status THEN old_status END AS st_from,
                 CASE WHEN old_status <> now_status THEN now_status END AS st_to, CASE WHEN old_scope <> now_scope THEN now_scope END AS sc_to
          FROM steps s JOIN documents ON doc_id = seq WHERE seq >= 0),
    flagged AS (SELECT *, scope = 'in_scope' OR coalesce(sc_to = 'in_scope', false) AS relevant, NOT is_new AND coalesce(st_to = 'completed', false) AS newly FROM d),
    noted AS (SELECT * FROM flagged WHERE NOT ((NOT relevant AND NOT is_new) OR (is_new AND status IN ('completed', 'deferred'))
              OR (NOT newly AND status = 'completed') OR (NOT is_new AND coalesce(st_to, '') <> 'deferred' AND status = 'deferred'))),
    about AS (SELECT *, 'Study=' || title || '|Municipalities=' || municipalities AS about FROM noted),
    shown AS (
      SELECT study_key, 0 AS kind_no, CAST(0 AS BIGINT) AS item, 'new' AS kind, 'NEW: ' || title AS title, source_url AS url, about || '|Summary=' || reason AS fields
        FROM about WHERE is_new AND scope = 'in_scope'
      UNION ALL SELECT study_key, 1, 0, 'status', 'UPDATED: ' || title, source_url, about || '|Status=' ||
        array_to_string(list_transform(string_split(st_from, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' → ' ||
        array_to_string(list_transform(string_split(st_to, '_'), lambda w: upper(w[1]) || w[2:]), ' ')
        FROM about WHERE NOT is_new AND st_to IS NOT NULL AND relevant
      UNION ALL SELECT study_key, 2, 0, 'scope', 'UPDATED: ' || title, source_url, about || '|Summary=' || reason FROM about WHERE sc_to = 'in_scope'
      UNION ALL SELECT study_key, 3, ord, 'event', 'NEW: Public Engagement Announced for ' || a.title, coalesce(n.url, source_url),
        'Study=' || a.title || '|Type=' || {SQL_TYPE_LABEL} || '|Date=' || {SQL_RANGE} || coalesce('|Location=' || nullif(location, ''), '') || coalesce('|Notes=' || nullif(notes, ''), '')
        FROM about a JOIN new n USING (study_key) WHERE relevant AND status <> 'completed'
          AND CASE WHEN end_date IS NOT NULL THEN end_date >= '{AS_OF}' WHEN event_date IS NOT NULL THEN event_date >= '{AS_OF}' ELSE true END
      UNION ALL SELECT study_key, 4, 0, 'documents', 'NEW: Documents Published for ' || a.title, source_url, 'Study=' || a.title || '|Documents=' || docs
        FROM about a JOIN (SELECT study_key, string_agg({SQL_LABEL}, chr(10) ORDER BY rank, pos) AS docs FROM merged GROUP BY study_key) USING (study_key)
        WHERE relevant AND (status <> 'completed' OR newly)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY study_key ORDER BY kind_no, item) AS message_no FROM shown)"""


def shown_fields(fields: Column) -> Column:
    return F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|")


@query(f"WITH {SQL_MESSAGES} SELECT study_key, kind, title, url, fields FROM shown")
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """All messages of the differences, with their fields."""
    out = notify.messages(*message_inputs(spark, sf), T.as_of_text(AS_OF))
    return out.select("study_key", "kind", "title", "url", shown_fields(F.col("fields")).alias("fields"))


@query(
    f"""WITH {SQL_MESSAGES}, m AS (SELECT study_key, bool_or(kind IN ('new', 'event')) AS any_mention FROM shown GROUP BY 1)
        SELECT study_key, (message_no - 1) // 10 AS chunk_no, count(*) AS n_messages, string_agg(message_no || ':' || kind, ' ' ORDER BY message_no) AS kinds,
               any_mention AND (message_no - 1) // 10 = 0 AS mention
        FROM numbered JOIN m USING (study_key) GROUP BY study_key, (message_no - 1) // 10, any_mention"""
)
def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Messages in order, ten to a payload, with the mention on the first."""
    out = notify.payloads(notify.messages(*message_inputs(spark, sf), T.as_of_text(AS_OF)).checkpoint())
    kinds = F.array_join(F.transform("messages", lambda m: F.concat(m["message_no"].cast("string"), F.lit(":"), m["kind"])), " ")
    return out.select("study_key", "chunk_no", F.size("messages").cast("bigint").alias("n_messages"), kinds.alias("kinds"), "mention")


@query(f"WITH {SQL_MESSAGES} SELECT study_key, bool_or(kind IN ('new', 'event')) AS mention FROM shown GROUP BY 1")
def role_mentions(spark: SparkSession, sf: str) -> DataFrame:
    out = notify.mentions(notify.messages(*message_inputs(spark, sf), T.as_of_text(AS_OF)))
    return out.select("study_key", "mention")


# --- whole runs -----------------------------------------------------------------------------


def landed_documents(spark: SparkSession, sf: str, day: int) -> DataFrame:
    """Documents as a card listing with one detail page each; some pages change by day."""
    # the given table is one file; landed pages are many
    docs = table(spark, sf, "documents").repartition("doc_id")
    edited = F.when((F.lit(day) > 1) & (F.col("doc_id") % 5 == 0), F.lit(" edited")).otherwise("")
    safe = F.regexp_replace(F.col("text"), "[&<>]", " ")
    details = docs.select(
        F.lit(OAKVILLE.name).alias("source"), F.lit("detail").alias("kind"), F.lit(0).alias("page_no"),
        F.concat(F.lit("https://www.oakville.ca/d/"), "doc_id").alias("url"),
        F.concat(F.lit('<main><div class="widget-text"><p>'), safe, edited, F.lit("</p></div></main>")).alias("body"),
    )
    card = F.concat(
        F.lit('<a class="card" href="/d/'), "doc_id", F.lit('"><b class="card-title">Study '), F.col("doc_id"), F.lit("</b></a>")
    )
    page_no = F.floor(F.col("doc_id") / ROWS_PER_PAGE).cast("int")
    listed = docs if day > 1 else docs.filter(F.col("doc_id") % 4 != 0)
    listings = (
        listed.select(page_no.alias("page_no"), card.alias("card"))
        .groupBy("page_no")
        .agg(F.array_join(F.array_sort(F.collect_list("card")), "").alias("cards"))
        .select(
            F.lit(OAKVILLE.name).alias("source"), F.lit("listing").alias("kind"), "page_no", F.concat(F.lit("l"), "page_no").alias("url"),
            F.concat(F.lit('<div class="widget-page-cards">'), "cards", F.lit("</div>")).alias("body"),
        )
    )
    return listings.unionByName(details)


def utc(c: str) -> Column:
    """A moment as its UTC wall time, whatever the session's zone."""
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").alias(c)


_RUN_TEXT = """(title || chr(10) || left(clean, 3000))"""


@query(
    f"""WITH t AS (SELECT doc_id, doc_id % 4 = 0 AS late, doc_id % 5 = 0 AS edited, 'Study ' || doc_id AS title,
                   regexp_replace(text, '[&<>]', ' ', 'g') || CASE WHEN doc_id % 5 = 0 THEN ' edited' ELSE '' END AS body FROM documents),
        c AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS clean FROM t)
        SELECT title, 'Town of Oakville' AS owner, 'https://www.oakville.ca/d/' || doc_id AS source_url,
               {SQL_SCOPE.replace(_BODY, _RUN_TEXT)} AS scope, {SQL_STATUS.replace(_BODY, _RUN_TEXT)} AS status,
               sha256('<p>' || body || '</p>') AS content_hash, late AS is_new, late OR edited AS changed,
               CASE WHEN late THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS inserted_at, TIMESTAMP '2024-01-02' AS updated_at FROM c"""
)
def two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two incremental runs over documents landed as pages: the final snapshot.

    The second run sees new records, edited pages and unchanged ones. The state
    goes to the shared folder of the session.
    """
    root = f"{use_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    settings = Settings(specs=(OAKVILLE,), classify=classify, buckets=8)
    for day in (1, 2):
        state = run(
            landed_documents(spark, sf, day), root, f"2024-01-0{day}", datetime(2024, 1, day, tzinfo=timezone.utc), settings
        )
    steps = state.run_table("assessments", SNAPSHOT + ", seq bigint, is_new boolean, changed boolean").filter("seq >= 0")
    return State(spark, root, 8).snapshot().join(steps.select("key", "is_new", "changed"), "key").select(
        "title", "owner", "source_url", "scope", "status", "content_hash", "is_new", "changed",
        utc("inserted_at"), utc("updated_at"),
    )


@query(
    """SELECT 'oakville' AS source, 'new' AS category, count(*) FILTER (WHERE doc_id % 4 = 0) AS n FROM documents
       UNION ALL SELECT 'oakville', 'changed', count(*) FILTER (WHERE doc_id % 4 <> 0 AND doc_id % 5 = 0) FROM documents
       UNION ALL SELECT 'oakville', 'unchanged', count(*) FILTER (WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0) FROM documents"""
)
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts per source of the second day's records."""
    rows = two_runs(spark, sf)
    outcome = F.when(F.col("is_new"), "new").when(F.col("changed"), "changed").otherwise("unchanged")
    return rows.groupBy(F.lit("oakville").alias("source"), outcome.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _one_run(spark: SparkSession, landed: DataFrame, judge=None) -> State:
    root = f"{use_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    settings = Settings(specs=(OAKVILLE,), classify=judge or classify, buckets=8)
    return run(landed, root, "2024-01-01", datetime(2024, 1, 1, tzinfo=timezone.utc), settings)


@query(
    """SELECT 'oakville' AS source, 'record' AS stage, 'unreadable page' AS error, 'https://www.oakville.ca/d/' || doc_id AS url
         FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 = 0
       UNION ALL SELECT 'oakville', 'record', 'no detail page', 'https://www.oakville.ca/d/' || doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 = 1
       UNION ALL SELECT 'oakville', 'landing', 'no source reads this kind: picture', 'https://www.oakville.ca/d/' || doc_id FROM documents WHERE doc_id % 7 = 2
       UNION ALL SELECT 'elsewhere', 'landing', 'no source reads this kind: detail', 'https://www.oakville.ca/d/' || doc_id FROM documents WHERE doc_id % 7 = 3
       UNION ALL SELECT DISTINCT 'oakville', 'listing', 'unreadable page', 'x' || doc_id // 100 FROM documents
       UNION ALL SELECT DISTINCT 'oakville', 'listing', 'bad page number', 'y' || doc_id // 100 FROM documents"""
)
def quarantined_pages(spark: SparkSession, sf: str) -> DataFrame:
    """What a run reports of pages it cannot use: unreadable, missing, of no source."""
    landed = landed_documents(spark, sf, 1)
    part = F.pmod(F.regexp_extract("url", "/d/([0-9]+)$", 1).try_cast("bigint"), F.lit(7))
    detail = F.col("kind") == "detail"
    pages = landed.filter(~detail | (part != 1)).withColumn("body", F.when(~detail | (part != 0), F.col("body")))
    strays = landed.filter(detail & part.isin(2, 3)).withColumns({
        "kind": F.when(part == 2, "picture").otherwise("detail"), "source": F.when(part == 2, OAKVILLE.name).otherwise("elsewhere")})
    blank = F.lit(None).cast("string")
    unread = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).cast("int").alias("page_no")).distinct().select(
        F.lit(OAKVILLE.name).alias("source"), F.lit("listing").alias("kind"), "page_no", F.concat(F.lit("x"), "page_no").alias("url"), blank.alias("body"))
    # listing pages without a number, of a negative one, or of one too large
    kind_of = F.pmod("page_no", F.lit(3))
    number = F.when(kind_of == 0, F.lit(None)).when(kind_of == 1, F.lit(-1)).otherwise(F.lit(1 << 24)).cast("int")
    lost = unread.select("source", "kind", number.alias("page_no"), F.concat(F.lit("y"), "page_no").alias("url"),
                         F.lit('<div class="widget-page-cards"><a class="card" href="/z"><b class="card-title">Z</b></a></div>').alias("body"))
    state = _one_run(spark, pages.unionByName(strays).unionByName(unread).unionByName(lost))
    return state.table("quarantine", QUARANTINE).select("source", "stage", "error", "url")


@query(
    """SELECT 'Study ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'unclassified' ELSE 'in_scope' END AS scope,
              doc_id % 3 <> 0 AS has_hash, CASE WHEN doc_id % 3 = 0 THEN 'classifier gave no valid answer' END AS error
       FROM documents WHERE doc_id % 4 <> 0"""
)
def failed_classifications(spark: SparkSession, sf: str) -> DataFrame:
    """A plug-in that gives no valid answer for some records: they are reported and stay to be tried again."""

    def answer(batch):
        number = batch["title"].str.extract(r"([0-9]+)")[0].astype(int)
        out = batch[["title"]].copy()
        out["scope"] = ["none of them" if n % 3 == 0 else "in_scope" for n in number]
        out["reasoning"], out["status"] = "asked", None
        return out

    state = _one_run(spark, landed_documents(spark, sf, 1), classify_by_function(answer))
    failed = state.table("quarantine", QUARANTINE).filter("stage = 'classify'").select(F.col("study_key").alias("key"), "error")
    return state.snapshot().join(failed, "key", "left").select("title", "scope", F.col("content_hash").isNotNull().alias("has_hash"), "error")


@query(
    """SELECT 'studies' AS metric, 'oakville' AS source, CAST(NULL AS VARCHAR) AS category, count(*) AS n FROM documents WHERE doc_id % 4 <> 0
       UNION ALL SELECT 'outcome', 'oakville', 'new', count(*) FROM documents WHERE doc_id % 4 <> 0"""
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that a run writes."""
    state = _one_run(spark, landed_documents(spark, sf, 1))
    rows = state.spark.read.parquet(f"{state.root}/metrics/run={state.run}")
    return rows.filter("metric in ('studies', 'outcome')").groupBy("metric", "source", "category").agg(F.sum("n").alias("n"))
