"""Queries over extraction, scalar functions and de-duplication."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.functions import html as H
from changewatch.functions import text as T
from changewatch.functions import urls as U
from changewatch.functions.elements import Rule
from changewatch.operators import dedupe, extract, quality
from changewatch.plans.catalog import (
    H1_TITLE,
    build_pages,
    query,
    spread,
    sql_collapse,
    sql_decode,
    sql_encode,
    sql_strip,
    table,
)
from changewatch.session import use_checkpoint_dir
from changewatch.sources.landed import newest, read_pages
from changewatch.sources.registry import BURLINGTON, BURLINGTON_NEWS, HALTON_REGION, OAKVILLE, SourceSpec

STATUS_TEXT = {"O": "On-going", "F": " COMPLETED ", "P": "Deferred"}


def status_text(c: str):
    out = F.lit("In Progress")
    for code, text in STATUS_TEXT.items():
        out = F.when(F.col(c) == code, F.lit(text)).otherwise(out)
    return out


SQL_STATUS_TEXT = (
    "CASE o_orderstatus WHEN 'O' THEN 'On-going' WHEN 'F' THEN ' COMPLETED ' WHEN 'P' THEN 'Deferred' ELSE 'In Progress' END"
)
SQL_STATUS = (
    "CASE o_orderstatus WHEN 'O' THEN 'on_going' WHEN 'F' THEN 'completed' WHEN 'P' THEN 'deferred' ELSE 'unknown' END"
)


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their cleaned heading."""
    return table(spark, sf, "pages").select(
        "page_id", "url", H.clean_text(H.first_element("html", "h1")).alias("title"), "html"
    )


# --- sources ------------------------------------------------------------------------


@query(
    """SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
              regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, length(html) AS n_chars FROM pages"""
)
def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"),
        U.url_path("url").alias("path"),
        F.length("html").cast("bigint").alias("n_chars"),
    )


@query(
    """SELECT url, 'detail' AS kind, CASE WHEN page_id % 3 = 0 THEN sha256('new' || html) ELSE sha256(html) END AS body_hash,
              CASE WHEN page_id % 3 = 0 THEN 3 WHEN page_id % 3 = 1 THEN 2 END AS day FROM pages
       UNION ALL SELECT 'list', 'listing', sha256('page ' || page_id), CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END FROM pages"""
)
def newest_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of landed pages, each with its moment: the newest of each page, read from a landing folder."""
    pages = table(spark, sf, "pages")

    def version(kind: str, day: int | None, body: Column, rows: Column | bool = True) -> DataFrame:
        number = F.col("page_id").cast("int") if kind == "listing" else F.lit(day)
        return pages.filter(F.lit(rows) if rows is True else rows).select(
            F.lit("s").alias("source"), F.lit(kind).alias("kind"), number.alias("page_no"),
            (F.lit("list") if kind == "listing" else F.col("url")).alias("url"), body.alias("body"),
            F.to_timestamp(F.lit(f"2025-01-0{day}" if day else None)).alias("landed_at"))

    third, second = F.col("page_id") % 3, F.col("page_id") % 2
    landed = [
        version("detail", None, F.when(third == 2, F.col("html")).otherwise(F.lit("without time"))),
        version("detail", 2, F.when(third == 1, F.col("html")).otherwise(F.lit("older")), third < 2),
        version("detail", 3, F.concat(F.lit("new"), "html"), third == 0), version("detail", 1, F.lit("oldest"), third == 0),
        version("listing", 1, F.when(second == 1, F.concat(F.lit("page "), "page_id")).otherwise(F.lit("older"))),
        version("listing", 2, F.concat(F.lit("page "), "page_id"), second == 0),
    ]
    folder = f"{use_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, landed).write.partitionBy("source", "kind").parquet(folder)
    found = newest(read_pages(spark, folder))
    return found.select("url", "kind", T.sha256_hex("body").alias("body_hash"), F.dayofmonth("landed_at").alias("day"))


FEED_PATH = BURLINGTON_NEWS.path_prefix


@query(
    f"""WITH items AS (
          SELECT event_id, event_id // 100 AS feed, user_id,
                 CASE event_type WHEN 'click' THEN '/en/news/festivals/' WHEN 'error' THEN '' ELSE '{FEED_PATH}' END AS folder,
                 event_type
          FROM events),
        linked AS (
          SELECT *, 'https://www.burlington.ca' || folder || user_id || '.aspx' AS source_url,
                 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
          FROM items WHERE folder = '{FEED_PATH}' AND feed % 10 NOT IN (3, 7) AND event_type <> 'signup')
        SELECT source_url, 'Notice ' || event_id AS title, 'unknown' AS status, event_type AS kind_of_title
        FROM linked WHERE rn = 1"""
)
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """JSON array feeds made of events; some feeds are broken, some no arrays."""
    kind = F.col("event_type")
    folder = F.when(kind == "click", "/en/news/festivals/").otherwise(FEED_PATH)
    link = F.when(kind == "error", F.lit(None)).otherwise(
        F.concat(
            F.when(kind == "view", F.lit("https://www.burlington.ca")).otherwise(""), folder, "user_id", F.lit(".aspx")
        )
    )
    # a missing title, and white space inside one
    title = F.when(kind == "signup", F.lit("  ")).otherwise(F.concat(F.lit(" Notice\n\t "), "event_id", F.lit(":"), kind))
    items = table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(title.alias("title"), link.alias("link"))).alias("piece")
    )
    feeds = build_pages(items, "event_id", F.concat("piece", F.lit(",")), "[", "null]", BURLINGTON_NEWS.name)
    broken = F.col("page_no") % 10
    feeds = feeds.withColumn(
        "body",
        F.when(broken == 3, F.concat(F.lit("not json"), "body"))
        .when(broken == 7, F.concat(F.lit('{"items":'), "body", F.lit("}")))
        .otherwise(F.col("body")),
    )
    rows = extract.studies(feeds, BURLINGTON_NEWS)
    parts = F.split("title", ":")
    return rows.select("source_url", parts[0].alias("title"), "status", parts[1].alias("kind_of_title"))


# --- listings -----------------------------------------------------------------------


@query(
    f"""SELECT CAST(o_orderkey // 100 AS INTEGER) AS page_no, CAST(o_orderkey % 100 AS INTEGER) AS row_no,
               'Order ' || o_orderkey AS title, o_orderpriority AS area, trim({SQL_STATUS_TEXT}) AS raw_status,
               {SQL_STATUS} AS status, 'https://www.halton.ca/orders/' || o_orderkey AS source_url FROM orders"""
)
def listing_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    row = F.concat(
        F.lit('<tr class="r"><td><a href="/orders/'), "o_orderkey", F.lit('"> Order '), "o_orderkey",
        F.lit(" </a></td><td>\n "), "o_orderpriority", F.lit("</td><td>"), status_text("o_orderstatus"), F.lit("</td></tr>"),
    )
    pages = build_pages(
        table(spark, sf, "orders"), "o_orderkey", row,
        '<table class="x hal-generic-smart-search-results-table"><tbody>',
        "<tr><td>short</td><td>row</td></tr></tbody></table>", HALTON_REGION.name,
    )
    return extract.table_rows(pages, HALTON_REGION).drop("source")


CARD_HREF = """CASE WHEN c_custkey % 11 = 5 THEN '' WHEN c_custkey % 7 = 3 THEN 'https://example.com/c/' || c_custkey
    WHEN c_custkey % 5 = 2 THEN '//cdn.example.com/c/' || c_custkey ELSE '/c/' || (c_custkey // 2) END"""
CARD_TITLE = "CASE WHEN c_custkey % 13 = 4 THEN '  ' ELSE '  ' || c_mktsegment || '  ' || c_name || ' ' END"


@query(
    f"""WITH cards AS (SELECT c_custkey, {CARD_HREF} AS href, trim({CARD_TITLE}) AS title FROM customer),
        full_urls AS (SELECT *, CASE WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE '/%' THEN 'https://www.oakville.ca' || href
                      ELSE href END AS source_url FROM cards WHERE href <> '' AND title <> ''),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY c_custkey) AS rn FROM full_urls)
        SELECT regexp_replace(title, ' +', ' ', 'g') AS title, source_url, 'Oakville' AS areas, 'unknown' AS status,
               '' AS raw_status, 'Town of Oakville' AS owner
        FROM ranked WHERE rn = 1"""
)
def listing_cards(spark: SparkSession, sf: str) -> DataFrame:
    # "//" is integer division in the SQL text
    card = F.expr(
        f"""concat('<a class="card wide" href="', {CARD_HREF.replace("c_custkey // 2", "c_custkey div 2")},
            '"><div class="card-title">', {CARD_TITLE}, '</div><div class="card-text">x</div></a>')"""
    )
    pages = build_pages(
        table(spark, sf, "customer"), "c_custkey", card, '<main><div class="widget-page-cards"><div>',
        '</div></div><a class="card" href="/outside"><b class="card-title">Outside</b></a></main>', OAKVILLE.name,
    )
    return extract.studies(pages, OAKVILLE).select(
        "title", "source_url", T.join_areas("areas").alias("areas"), "status", "raw_status", "owner"
    )


@query(
    """SELECT p_type || ' & ' || p_name || ' ' || p_partkey AS title,
              'https://www.getinvolvedburlington.ca/' || p_partkey AS source_url, p_brand AS raw_status, 'Burlington' AS areas
       FROM part"""
)
def listing_tiles(spark: SparkSession, sf: str) -> DataFrame:
    tile = F.concat(
        F.lit("<div class='project-tile' data-state='"), "p_brand",
        F.lit("'><div class='project-tile__card'><a class=\"project-tile__link\" href=\"/"), "p_partkey",
        F.lit("\"><div class='project-tile__meta'><span class='project-tile__meta__name'>  "), "p_type",
        F.lit(" &amp;amp;\n\t "), "p_name", F.lit(" "), "p_partkey", F.lit("</span></div></a></div></div>"),
    )
    pages = build_pages(
        table(spark, sf, "part"), "p_partkey", tile, "<div class='project-tile-wrapper row'>", "</div>", BURLINGTON.name
    )
    return extract.studies(pages, BURLINGTON).select(
        "title", "source_url", "raw_status", T.join_areas("areas").alias("areas")
    )


@query(
    """SELECT p_type || ' & ' || p_name || ' ' || p_partkey AS title, '/' || p_partkey AS href, p_brand AS raw_status
       FROM part"""
)
def listing_tiles_native(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles again, by slicing the page at each tile inside Catalyst."""
    tile = F.concat(
        F.lit("<div class='project-tile' data-state='"), "p_brand", F.lit("'><p><a class=\"project-tile__link\" href=\"/"),
        "p_partkey", F.lit("\"><span class='project-tile__meta__name'>  "), "p_type", F.lit(" &amp;amp;\n\t "), "p_name",
        F.lit(" "), "p_partkey", F.lit("</span></a></p></div>"),
    )
    pages = build_pages(table(spark, sf, "part"), "p_partkey", tile, "<div>", "</div>", "x")
    tiles = pages.select(F.explode(H.slice_elements("body", "div", "project-tile")).alias("t"))
    name = F.get(H.elements("t", "span", "project-tile__meta__name"), F.lit(0))
    link = F.get(H.elements("t", "a", "project-tile__link"), F.lit(0))
    return tiles.select(
        T.collapse_ws(T.decode_entities(H.clean_text(name))).alias("title"),
        H.attribute(link, "href").alias("href"),
        H.attribute("t", "data-state").alias("raw_status"),
    )


# --- detail pages -------------------------------------------------------------------

_PAGES_SPEC = SourceSpec(
    name="pages",
    owner="Pages",
    base_url="https://www.example.ca",
    layout="cards",
    infer_status=True,
    heading_first=True,
    hash_links=True,
    detail=(
        Rule("block", "div.ad", {"text": ((), "text"), "html": ((), "html")}),
        Rule("heading", "h1", {"text": ((), "text")}, first=True),
        Rule("main", ":root", {"text": ((), "text")}, within="article", otherwise="body", first=True),
        Rule("link", "nav li a", {"title": ((), "text"), "href": ((), "attr:href")}),
    ),
)

_AD = "regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_LINKS_SQL = f"""
    anchors AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1)) AS href,
                       unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS label,
                       generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1), 1) AS n
                FROM pages),
    urls AS (SELECT page_id, n, {sql_collapse(sql_decode("label"))} AS title,
                    'https://www.example.ca' || {sql_encode(sql_decode("href"))} AS url FROM anchors),
    links AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS rn FROM urls WHERE title <> '')"""


@query(f"WITH {_LINKS_SQL} SELECT page_id, n AS link_no, title, url FROM links WHERE rn = 1")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Navigation links per page, native tier; first-seen distinct by URL."""
    anchors = table(spark, sf, "pages").select("page_id", H.elements("html", "li").alias("li"))
    links = anchors.select(
        "page_id",
        F.transform(
            "li",
            lambda e, i: F.struct(
                (i + 1).cast("bigint").alias("link_no"),
                H.clean_text(e).alias("title"),
                U.absolute_url(H.attribute(H.inner_html(e), "href"), "https://www.example.ca").alias("url"),
            ),
        ).alias("links"),
    )
    kept = dedupe.first_seen_in(F.filter("links", lambda x: x["title"] != ""), "url")
    return links.select("page_id", F.explode(kept).alias("l")).select("page_id", "l.*")


@query(f"WITH {_LINKS_SQL} SELECT page_id, title, url FROM links WHERE rn = 1")
def page_links_by_selector(spark: SparkSession, sf: str) -> DataFrame:
    """The same links by the selector tier."""
    pages = spread(table(spark, sf, "pages"), "page_id").select(F.lit("pages").alias("source"), F.col("page_id").alias("url"), F.col("html").alias("body"))
    return (
        extract.details(pages, _PAGES_SPEC)
        .select(F.col("url").alias("page_id"), F.explode("document_links").alias("l"))
        .select("page_id", "l.title", "l.url")
    )


@query(
    f"""WITH {_LINKS_SQL},
        text AS (SELECT page_id, {sql_collapse(sql_decode(_AD))} AS ad, {H1_TITLE} AS h1, {_AD} AS raw,
                        {sql_collapse(sql_decode(sql_strip(_ARTICLE)))} AS main FROM pages),
        joined AS (SELECT page_id, string_agg(title || url, '' ORDER BY n) AS fp, count(*) AS n_links FROM links WHERE rn = 1 GROUP BY page_id)
        SELECT page_id, left(CASE WHEN ad <> '' THEN ad ELSE concat_ws(chr(10) || chr(10), nullif(h1, ''), nullif(main, '')) END, 3000) AS description,
               coalesce(n_links, 0) AS n_links, sha256(raw || coalesce(fp, '')) AS content_hash
        FROM text LEFT JOIN joined USING (page_id)"""
)
def page_details(spark: SparkSession, sf: str) -> DataFrame:
    """Block text, or heading and main text where the block is empty; content hash."""
    pages = spread(table(spark, sf, "pages"), "page_id").select(F.lit("pages").alias("source"), F.col("page_id").alias("url"), F.col("html").alias("body"))
    return extract.details(pages, _PAGES_SPEC, hash_fallback=False).select(
        F.col("url").alias("page_id"), "description", F.size("document_links").cast("bigint").alias("n_links"), "content_hash"
    )


_PARAGRAPHS = "regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>.*?</p>')"


@query(
    f"""WITH p AS (SELECT page_id, unnest({_PARAGRAPHS}) AS el, generate_subscripts({_PARAGRAPHS}, 1) AS n FROM pages),
        t AS (SELECT page_id, n, {sql_collapse(sql_decode(sql_strip("el")))} AS t FROM p),
        j AS (SELECT page_id, left(string_agg(t, chr(10) || chr(10) ORDER BY n), 3000) AS description FROM t WHERE t <> '' GROUP BY page_id)
        SELECT page_id, coalesce(description, '') AS description, sha256(coalesce(description, '')) AS content_hash
        FROM pages LEFT JOIN j USING (page_id)"""
)
def page_block_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of all paragraphs, native tier."""
    texts = F.transform(H.elements("html", "p"), H.text_of)
    return (
        table(spark, sf, "pages")
        .select("page_id", extract.block_text(texts).alias("description"))
        .withColumn("content_hash", T.sha256_hex("description"))
    )


@query(
    """SELECT page_id, regexp_replace(trim(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)), 'href="(/[^"]+)"',
              'href="https://www.example.ca\\1"', 'g') AS block_html FROM pages"""
)
def page_block_html(spark: SparkSession, sf: str) -> DataFrame:
    """Inner HTML of the navigation block, its links made absolute."""
    blocks = F.transform(H.elements("html", "nav"), H.inner_html)
    return table(spark, sf, "pages").select(
        "page_id", extract.block_html(blocks, "https://www.example.ca").alias("block_html")
    )


@query(
    """SELECT 'https://www.halton.ca/d/' || c_custkey || '.pdf' AS url, c_name AS title,
              CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment || ' 2024' END AS published_label FROM customer
       UNION ALL SELECT 'https://www.halton.ca/d/' || c_custkey || '.pdf', 'Again ' || c_name, NULL FROM customer WHERE c_custkey % 4 = 1"""
)
def dated_document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Document rows with a date label; repeats stay."""
    href = F.concat(F.lit('<a href="/d/'), "c_custkey", F.lit('.pdf">'))
    row = F.concat(
        F.lit('<div class="hal-ea-studies-listing-row"><div>'), href, F.lit(" "), "c_name", F.lit(" </a></div>"),
        F.when(
            F.col("c_custkey") % 3 != 0,
            F.concat(F.lit('<span class="hal-ea-studies-listing-item-report-date"> '), "c_mktsegment", F.lit(" 2024</span>")),
        ).otherwise(""),
        F.lit("</div>"),
        F.when(
            F.col("c_custkey") % 4 == 1,
            F.concat(F.lit('<div class="hal-ea-studies-listing-row">'), href, F.lit("Again "), "c_name", F.lit("</a></div>")),
        ).otherwise(""),
    )
    pages = build_pages(table(spark, sf, "customer"), "c_custkey", row, "<body>", "</body>", HALTON_REGION.name)
    return (
        extract.details(pages, HALTON_REGION)
        .select(F.explode("document_links").alias("l"))
        .select("l.url", "l.title", F.col("l.date").alias("published_label"))
    )


@query(
    """SELECT 'https://www.getinvolvedburlington.ca/' || (p_partkey // 2) || '/widgets' AS url, arg_min(p_name, p_partkey) AS title
       FROM part GROUP BY p_partkey // 2"""
)
def document_links_by_class(spark: SparkSession, sf: str) -> DataFrame:
    anchor = F.expr(
        """concat('<li><a class="document-library-widget-link x" href="/', p_partkey div 2, '/widgets"> ', p_name,
           ' </a><a href="/other">other</a></li>')"""
    )
    pages = build_pages(table(spark, sf, "part"), "p_partkey", anchor, "<ul>", "</ul>", BURLINGTON.name)
    return (
        extract.details(pages, BURLINGTON).select(F.explode("document_links").alias("l")).select("l.url", "l.title")
    )


@query(
    """SELECT 'https://www.burlington.ca/en/news/resources/' || o_orderkey || '.' ||
              CASE o_orderstatus WHEN 'O' THEN 'pdf' WHEN 'P' THEN 'DOCX?v=1' END AS url, 'Doc ' || o_orderkey AS title
       FROM orders WHERE o_orderstatus <> 'F'"""
)
def document_links_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Links to files under the resources path, inside the main content only."""
    anchor = F.expr(
        """concat('<p><a href="/en/news/resources/', o_orderkey, '.', CASE o_orderstatus WHEN 'O' THEN 'pdf' WHEN 'P' THEN 'DOCX?v=1'
           ELSE 'txt' END, '">Doc ', o_orderkey, '</a>')"""
    )
    pages = build_pages(
        table(spark, sf, "orders"), "o_orderkey", anchor, '<div id="mainContent"><div>',
        '</div></div><a href="/en/news/resources/outside.pdf">Outside</a>', BURLINGTON_NEWS.name,
    )
    return (
        extract.details(pages, BURLINGTON_NEWS).select(F.explode("document_links").alias("l")).select("l.url", "l.title")
    )


# --- scalar functions ---------------------------------------------------------------


@query(f"SELECT page_id, {H1_TITLE} AS title FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return titled(spark, sf).select("page_id", "title")


@query(
    """SELECT doc_id, sha256(text) AS content_hash, sha256(trim(regexp_replace(text, '[\\s\\x{000B}\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}]+', ' ', 'g'))) AS clean_hash,
              left(text, 3000) AS head FROM documents"""
)
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", T.sha256_hex("text").alias("content_hash"), T.sha256_hex(T.collapse_ws("text")).alias("clean_hash"),
        T.truncate("text").alias("head"),
    )


_HREF_FORMS = (
    "CASE o_orderkey % 10 WHEN 0 THEN 'https://other.example.com/a/' || o_orderkey WHEN 1 THEN '//cdn.example.com/x/' || o_orderkey"
    " WHEN 2 THEN '/study/' || o_orderkey || '-(' || (o_orderkey % 7) || ')' WHEN 3 THEN 'bare/' || o_orderkey"
    " WHEN 4 THEN '?page=' || o_orderkey WHEN 5 THEN '#-(1)' WHEN 6 THEN 'http://[invalid' WHEN 7 THEN 'HTTPS://Host.Example.COM:443/' || o_orderkey"
    " WHEN 8 THEN '/a/./b/../' || o_orderkey || '/' ELSE ' /with space/é' || o_orderkey || ' ' END"
)
_RESOLVED = (
    "CASE o_orderkey % 10 WHEN 0 THEN 'https://other.example.com/a/' || o_orderkey WHEN 1 THEN 'https://cdn.example.com/x/' || o_orderkey"
    " WHEN 2 THEN 'https://www.example.ca/study/' || o_orderkey || '-(' || (o_orderkey % 7) || ')' WHEN 3 THEN 'https://www.example.ca/list/bare/' || o_orderkey"
    " WHEN 4 THEN 'https://www.example.ca/list/index?page=' || o_orderkey WHEN 5 THEN 'https://www.example.ca/list/index#-(1)' WHEN 6 THEN 'http://[invalid'"
    " WHEN 7 THEN 'https://host.example.com/' || o_orderkey WHEN 8 THEN 'https://www.example.ca/a/' || o_orderkey || '/'"
    " ELSE 'https://www.example.ca/with%20space/%C3%A9' || o_orderkey END"
)


@query(
    f"""SELECT o_orderkey, {_RESOLVED} AS url, o_orderkey % 10 = 2 AS suffixed,
               o_orderkey % 10 IN (3, 4, 5) AS listed FROM orders"""
)
def url_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every form of link, resolved; suffix and path-prefix tests."""
    hrefs = table(spark, sf, "orders").select("o_orderkey", F.expr(_HREF_FORMS).alias("href"))
    resolved = hrefs.withColumn("url", U.absolute_url("href", "https://www.example.ca/list/index"))
    return resolved.select(
        "o_orderkey", "url", U.has_suffixed_url("url").alias("suffixed"), U.path_starts_with("url", "/list/").alias("listed")
    )


@query(
    f"""SELECT o_orderkey, {SQL_STATUS} AS status,
               CASE o_orderstatus WHEN 'O' THEN 'On Going' WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Deferred' ELSE 'Unknown' END AS label
        FROM orders"""
)
def status_labels(spark: SparkSession, sf: str) -> DataFrame:
    status = table(spark, sf, "orders").select("o_orderkey", T.normalise_status(status_text("o_orderstatus")).alias("status"))
    return status.withColumn("label", T.format_status("status"))


# --- de-duplication -----------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT page_id, url, {H1_TITLE} AS title FROM pages)
        SELECT title, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM t GROUP BY title"""
)
def first_page_per_title(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.first_seen(titled(spark, sf).drop("html"), ["title"], ["page_id"])


_PAGED = f"""rows AS (SELECT regexp_extract(html, '<html lang="([a-z]*)"', 1) AS source, page_id, CAST(page_id // 10 AS INTEGER) AS page_no,
                             'u/' || {H1_TITLE} AS source_url FROM pages),
             numbered AS (SELECT *, min(page_no) OVER (PARTITION BY source, source_url) AS first_no FROM rows),
             counts AS (SELECT source, page_no, count(*) FILTER (WHERE first_no = page_no) AS fresh FROM numbered GROUP BY 1, 2),
             stops AS (SELECT source, min(page_no) AS stop FROM counts WHERE fresh = 0 GROUP BY 1)"""


@query(
    f"""WITH {_PAGED} SELECT n.source, page_id, page_no, source_url FROM numbered n LEFT JOIN stops USING (source)
        WHERE first_no = page_no AND (stop IS NULL OR page_no < stop)"""
)
def paged_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on new pages, up to the source's first page that adds nothing."""
    rows = titled(spark, sf).select(
        F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("source"),
        "page_id",
        F.floor(F.col("page_id") / 10).cast("int").alias("page_no"),
        F.concat(F.lit("u/"), "title").alias("source_url"),
    )
    return dedupe.until_repeat(rows, rows.select("source", "page_no"))


@query(
    f"""WITH t AS (SELECT page_id, {H1_TITLE} AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS area,
                          CASE WHEN page_id % 3 = 0 THEN url || '-(1)' ELSE url END AS u FROM pages),
        s AS (SELECT *, regexp_matches(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '-\\([0-9]+\\)$') AS suffixed FROM t),
        a AS (SELECT title, area, min(page_id) AS pos FROM s GROUP BY 1, 2),
        j AS (SELECT title, string_agg(area, ', ' ORDER BY pos) AS areas FROM a GROUP BY 1)
        SELECT title, areas, coalesce(arg_min(u, page_id) FILTER (WHERE NOT suffixed), arg_min(u, page_id)) AS source_url,
               arg_min(CAST(page_id % 4 AS VARCHAR), page_id) AS status, min(page_id) AS first_pos
        FROM s JOIN j USING (title) GROUP BY title, areas"""
)
def merged_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the same title as one record: areas, canonical URL, first status."""
    rows = titled(spark, sf).select(
        F.lit("pages").alias("source"), "title", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("area"),
        (F.col("page_id") % 4).cast("string").alias("status"), F.lit("").alias("raw_status"),
        F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("-(1)"))).otherwise(F.col("url")).alias("source_url"), "page_id",
    )
    return dedupe.merge_by_title(rows, ["page_id"]).select(
        "title", T.join_areas("areas").alias("areas"), "source_url", "status", "first_pos"
    )


@query(
    """SELECT source, regexp_extract(text, '^[^\\n]*') AS title, arg_max(sha256(text), doc_id) AS content_hash,
              arg_max(lang, doc_id) AS lang, min(doc_id) AS first_pos, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2"""
)
def last_wins_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents keyed by source and first line: last values, first position."""
    rows = table(spark, sf, "documents").select(
        "source", F.regexp_extract("text", "^[^\\n]*", 0).alias("title"), T.sha256_hex("text").alias("content_hash"), "lang", "doc_id"
    )
    return dedupe.last_wins(rows, ["source", "title"], ["doc_id"])


# --- evolution ----------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT {H1_TITLE} AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS area, page_id FROM pages),
        a AS (SELECT title, area, min(page_id) AS pos FROM t GROUP BY 1, 2),
        j AS (SELECT title, string_agg(area, ', ' ORDER BY pos) AS areas, bool_or(area = 'en') AS hit, count(*) AS n FROM a GROUP BY 1)
        SELECT title, areas, n AS n_areas FROM j WHERE hit"""
)
def covering_area(spark: SparkSession, sf: str) -> DataFrame:
    """One area column turned into an array, then searched for one area."""
    rows = titled(spark, sf).select(
        F.lit("p").alias("source"), "title", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("area"),
        F.lit("unknown").alias("status"), F.lit("").alias("raw_status"), F.col("url").alias("source_url"), "page_id",
    )
    merged = dedupe.merge_by_title(rows, ["page_id"])
    return quality.covering_area(merged, "en").select(
        "title", T.join_areas("areas").alias("areas"), F.size("areas").cast("bigint").alias("n_areas")
    )
