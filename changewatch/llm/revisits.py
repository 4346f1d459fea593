"""WARC revisit records of the not-modified kind, resolved to the response they confirm.

A revisit says "304 Not Modified": its payload is that of an earlier capture. Each revisit is joined
as of its time to the latest earlier full response of the same canonical URL; earlier means a
smaller time, or the same time and a smaller record id. The response counts if the
revisit's validator fits it: the entity tag (compared weakly) if it has one, else the
last-modified date. Then the stored headers are updated by those of the revisit, but for
connection headers and those that describe the payload.

Only narrow columns take part: payloads stay where they are and are named by record id and digest.
A URL with very many captures is cut into blocks of about ``EVERY`` rows by time; a block starts from the last
response of the blocks before it, so no URL is one task.

Outcomes: ``resolved``; ``validator_mismatch`` (the latest response is another version);
``unvalidated`` (the revisit has no validator); ``no_response`` (none is earlier);
``no_url`` (the URL is null or not absolute). Only ``resolved`` rows name a response; the others
keep their own headers. Header names are lower-cased; of a name that a map has twice the first
stays. Null headers are empty. Rows without a time are earlier than nothing and later than nothing.
Repeated records give a row each. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import Scan
from .catalog import query, table

EVERY = 10_000

# --- fixed values: headers that a not-modified answer does not update ---
KEPT_HEADERS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-authentication-info", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-type", "content-range",
)

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, at least "/" as path; null if not absolute."""
    scheme = F.lower(F.regexp_extract(url, URL, 1))
    host = F.lower(F.regexp_extract(url, URL, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    path = F.regexp_extract(url, URL, 3)
    return F.when(
        host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, URL, 4))
    )


def tidy_headers(headers: Column) -> Column:
    """Header names in lower case, the first of equal ones."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` updated by the permitted headers of ``fresh``; names are lower-case already."""
    fixed = F.array(*[F.lit(h) for h in KEPT_HEADERS])
    named = F.split(F.lower(F.coalesce(fresh["connection"], F.lit(""))), r"\s*,\s*")
    update = F.map_filter(fresh, lambda k, v: ~F.array_contains(fixed, k) & ~F.array_contains(named, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, every: int = EVERY) -> DataFrame:
    """(record_id, url, outcome, refers_to, payload_digest, headers) of each revisit.

    ``records``: record_id bigint, record_type ("response" or "revisit"), url string, ts bigint,
    status int, headers map<string,string>, payload_digest string. A full response is one of status 200.
    """
    rows = records.filter("record_type in ('response', 'revisit')").select(
        "record_id", "record_type", canonical_url(F.col("url")).alias("url"), "ts",
        F.coalesce((F.col("record_type") == "response") & (F.col("status") == 200), F.lit(False)).alias("full"),
        tidy_headers(F.col("headers")).alias("headers"), "payload_digest",
    )
    placed = rows.filter("url is not null and ts is not null")
    scan = Scan(placed, ["url"], "ts", every)
    response = F.struct("record_id", "payload_digest", "headers")
    before = Window.partitionBy(*scan.group).orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = scan.df.withColumn("last", F.last(F.when(F.col("full"), response), ignorenulls=True).over(before))
    if scan.hot:
        ends = scan.df.filter("_hot and full").groupBy("url", "_block").agg(
            F.max_by(response, F.struct("ts", "record_id")).alias("end")
        )
        # each block of a cut URL needs the last response of those before it, whether it has one itself or not
        blocks = scan.df.filter("_hot").select("url", "_block").distinct().join(ends, ["url", "_block"], "left")
        earlier = Window.partitionBy("url").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select("url", "_block", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
        found = found.join(carried, ["url", "_block"], "left").withColumn("last", F.coalesce("last", "carried"))
    revisits = found.filter("record_type = 'revisit'").select("record_id", "url", "headers", "last")
    nothing = F.lit(None).cast(found.schema["last"].dataType)
    revisits = revisits.union(
        rows.filter("record_type = 'revisit' and (url is null or ts is null)").select("record_id", "url", "headers", nothing)
    )
    mine, theirs = F.col("headers"), F.col("last.headers")
    outcome = (
        F.when(F.col("url").isNull(), "no_url")
        .when(F.col("last").isNull(), "no_response")
        .when(mine["etag"].isNotNull(), F.when(_tag(mine) == _tag(theirs), "resolved").otherwise("validator_mismatch"))
        .when(mine["last-modified"].isNotNull(),
              F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    judged = revisits.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return judged.select(
        "record_id", "url", "outcome", F.when(ok, F.col("last.record_id")).alias("refers_to"),
        F.when(ok, F.col("last.payload_digest")).alias("payload_digest"),
        F.when(ok, merged_headers(theirs, mine)).otherwise(mine).alias("headers"),
    )


def capture_records(pages: DataFrame) -> DataFrame:
    """WARC records derived from ``pages``: captures of each site's front page of a language.

    The page id is the time. By its checksum a capture is a response, a revisit with an
    entity tag, or one with a date; versions change every 64 captures.
    """
    kind = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(4))
    version = F.floor(F.col("page_id") / 64).cast("string")
    full = kind == 0
    text = F.col("page_id").cast("string")
    front = F.concat(F.regexp_extract("url", r"^([^/]*//[^/]*/[a-z]*)", 1), F.regexp_extract("url", "(#.*)$", 1))
    return pages.select(
        F.col("page_id").alias("record_id"),
        F.when(full, "response").otherwise("revisit").alias("record_type"),
        front.alias("url"), F.col("page_id").alias("ts"),
        F.when(full, 200).otherwise(304).alias("status"),
        F.when(full, F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"),
            F.lit("ETag"), F.concat(F.lit('"'), version, F.lit('"')), F.lit("Last-Modified"), version, F.lit("Date"), text,
        )).when(kind == 1, F.create_map(
            F.lit("Date"), text, F.lit("Last-Modified"), version, F.lit("Content-Length"), F.lit("0"),
        )).otherwise(F.create_map(
            F.lit("date"), text, F.lit("ETag"), F.concat(F.lit('W/"'), version, F.lit('"')), F.lit("Connection"), F.lit("X-Hop"),
            F.lit("X-Hop"), F.lit("1"), F.lit("Cache-Control"), F.lit("max-age=60"),
        )).alias("headers"),
        F.when(full, F.md5("html")).alias("payload_digest"),
    )


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, html, CAST(page_id // 64 AS VARCHAR) AS v, CAST(page_id AS VARCHAR) AS t,
    lower(regexp_extract(url, '^([^/]*//[^/]*)', 1)) || regexp_extract(url, '^[^/]*//[^/]*(/[a-z]*)', 1) AS url FROM pages
), k AS (
  SELECT *, (CASE WHEN page_id IS NULL THEN NULL ELSE KIND END) AS kind FROM p
), f AS (
  SELECT *, last_value(CASE WHEN kind = 0 THEN page_id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k
), j AS (
  SELECT f.*, s.v AS sv, s.html AS shtml, CASE WHEN seen IS NULL THEN 'no_response' WHEN s.v = f.v THEN 'resolved'
    ELSE 'validator_mismatch' END AS outcome FROM f LEFT JOIN p s ON s.page_id = f.seen WHERE f.kind <> 0
)
SELECT page_id AS record_id, url, outcome, CASE WHEN outcome = 'resolved' THEN seen END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN md5(shtml) END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN
    (CASE WHEN kind = 1 THEN '' ELSE 'cache-control: max-age=60; ' END) || 'content-length: ' || strlen(shtml) || '; content-type: text/html; date: ' || t ||
    '; etag: ' || (CASE WHEN kind = 1 THEN '' ELSE 'W/' END) || '"' || v || '"; last-modified: ' || v
  WHEN kind = 1 THEN 'content-length: 0; date: ' || t || '; last-modified: ' || v
  ELSE 'cache-control: max-age=60; connection: X-Hop; date: ' || t || '; etag: W/"' || v || '"; x-hop: 1' END AS headers
FROM j
"""


# crc32 in SQL: by table-free bit steps over the digits of the id
def _crc32_sql(text: str) -> str:
    step = "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    fold = f"list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda c, i: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {fold}), 4294967295)"


OP3_SQL = OP3_SQL.replace("KIND", f"{_crc32_sql('t')} % 4")


@query(OP3_SQL)
def op3_warc_revisits(spark, folder):
    resolved = resolve_revisits(capture_records(table(spark, folder, "pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.withColumn("headers", F.array_join(entries, "; "))
