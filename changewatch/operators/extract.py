"""From landed pages to normalised records: listings, details, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.functions import text as T
from changewatch.functions import urls as U
from changewatch.functions.elements import Rule, first_value, of_rule, with_matches
from changewatch.model import DOCUMENT_LINK, PAGE_BITS
from changewatch.operators import dedupe
from changewatch.sources.landed import feed_items, page_key, without_rows
from changewatch.sources.registry import SourceSpec

STUDY_COLUMNS = ["source", "owner", "title", "areas", "status", "raw_status", "source_url", "pos"]


def position(page_no: Column | str = "page_no", row_no: Column | str = "row_no") -> Column:
    """(page, row) as one sortable bigint: aggregates on it stay in hash tables."""
    page = F.col(page_no) if isinstance(page_no, str) else page_no
    row = F.col(row_no) if isinstance(row_no, str) else row_no
    return F.shiftleft(page.cast("bigint"), 32) + row.cast("bigint")


def parsed(landed: DataFrame, specs: tuple[SourceSpec, ...]) -> DataFrame:
    """One pass over the landed pages of all sources: matches in ``m``, feeds as text.

    Written as a table it takes the place of the pages in all that follows. ``version`` and ``row`` tell rows of one
    page apart (:func:`single`). Listing pages without a usable number are left out (:func:`misnumbered`).
    """
    rules = {f"{s.name}/{kind}": r for s in specs for kind, r in (("listing", s.listing), ("detail", s.detail))}
    feeds = [s.name for s in specs if s.layout == "feed"]
    is_feed = F.col("source").isin(feeds) & (F.col("kind") == "listing")
    html = F.when(~is_feed, F.col("body"))
    own = landed.filter(F.col("source").isin([s.name for s in specs]) & ((F.col("kind") != "listing") | numbered()))
    return with_matches(own, html, rules, F.concat_ws("/", "source", "kind")).select(
        "source", "kind", "page_no", "url", F.when(is_feed, F.col("body")).alias("body"), "m",
        F.xxhash64("body").alias("version"), F.monotonically_increasing_id().alias("row"),
    )


def single(pages: DataFrame) -> DataFrame:
    """``pages``, a table of :func:`parsed`, with each page once; of several texts that of the smallest hash. No text is shuffled."""
    names = ["_source", "_kind", "_url", "_page_no"]
    keys = [k.alias(n) for k, n in zip(page_key(), names, strict=True)]
    rows = pages.select(*keys, "version", "row")
    twice = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min(F.struct("version", "row")).alias("one")).filter("n > 1").checkpoint()
    if twice.isEmpty():
        return pages
    same = F.lit(True)
    for n in names:
        same = same & rows[n].eqNullSafe(twice[n])
    spare = rows.join(twice, same).filter("row <> one.row").select(F.col("row").alias("_row")).checkpoint()
    return without_rows(pages, spare, F.col("row") == F.col("_row"))


def numbered() -> Column:
    """Whether a listing page's number can be part of its rows' places."""
    return F.coalesce(F.col("page_no").between(0, (1 << PAGE_BITS) - 1), F.lit(False))


def misnumbered(landed: DataFrame, specs: tuple[SourceSpec, ...]) -> DataFrame:
    """Listing pages left out for want of a usable number: source, kind, url."""
    listing = F.col("source").isin([s.name for s in specs]) & (F.col("kind") == "listing")
    return landed.filter(listing & ~numbered()).select("source", "kind", "url")


def unreadable(pages: DataFrame, specs: tuple[SourceSpec, ...]) -> DataFrame:
    """Pages of :func:`parsed` from which nothing could be read: source, kind, url."""
    feeds = [s.name for s in specs if s.layout == "feed"]
    no_feed = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>").isNull()
    is_feed = F.col("source").isin(feeds) & (F.col("kind") == "listing")
    return pages.filter(F.when(is_feed, no_feed).otherwise(F.col("m").isNull())).select("source", "kind", "url")


def unknown(landed: DataFrame, specs: tuple[SourceSpec, ...]) -> DataFrame:
    """Landed rows that no specification reads: source, kind, url."""
    read = F.col("source").isin([s.name for s in specs]) & F.col("kind").isin("listing", "detail")
    return landed.filter(~F.coalesce(read, F.lit(False))).select("source", "kind", "url")


def _matched(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return pages if "m" in pages.columns else with_matches(pages, "body", {"": rules})


# --- listings -------------------------------------------------------------------------


def table_rows(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """Rows of a listing table: title, area, raw status, url; at least three cells."""
    v = _exploded(pages, spec)
    return v.select(
        "source",
        "page_no",
        "row_no",
        # an anchor with empty text does not fall back to the cell
        T.trim_ws(F.coalesce(F.col("v.anchor"), F.col("v.cell"))).alias("title"),
        T.trim_ws("v.area").alias("area"),
        T.trim_ws("v.state").alias("raw_status"),
        T.normalise_status("v.state").alias("status"),
        U.absolute_url(F.coalesce("v.href", F.lit("")), spec.base_url).alias("source_url"),
    ).filter((F.col("v.cells").cast("int") >= 3) & (F.col("title") != ""))


def linked_items(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """Cards or tiles: link, title, and the tile's state as raw status."""
    title = T.collapse_ws("v.title")
    if spec.layout == "tiles":
        # the markup encodes these titles twice
        title = T.collapse_ws(T.decode_entities(title))
    state = F.coalesce(F.col("v.state"), F.lit("")) if spec.layout == "tiles" else F.lit("")
    return (
        _exploded(pages, spec)
        .filter(F.col("v.href") != "")
        .select(
            "source",
            "page_no",
            "row_no",
            title.alias("title"),
            F.lit(spec.area).alias("area"),
            state.alias("raw_status"),
            F.lit("unknown").alias("status"),
            U.absolute_url("v.href", spec.base_url).alias("source_url"),
        )
        # before the url is taken as seen: an untitled card does not use it up
        .filter(F.col("title") != "")
    )


def feed_rows(feeds: DataFrame, spec: SourceSpec) -> DataFrame:
    """Items of a JSON feed that lie under the source's path."""
    items = feed_items(feeds, "body", ["source", "page_no"], ("title", "link"))
    return (
        items.withColumn("link", T.trim_ws("link"))
        .filter(F.col("link") != "")
        .withColumn("source_url", U.try_absolute_url("link", spec.base_url))
        .filter(U.path_starts_with("source_url", spec.path_prefix or "/"))
        .select(
            "source",
            "page_no",
            "row_no",
            T.collapse_ws("title").alias("title"),
            F.lit(spec.area).alias("area"),
            F.lit("").alias("raw_status"),
            F.lit("unknown").alias("status"),
            "source_url",
        )
        .filter(F.col("title") != "")
    )


def _exploded(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    return _matched(pages, spec.listing).select("source", "page_no", F.explode(of_rule("m", "row")).alias("m")).select(
        "source", "page_no", F.col("m.idx").alias("row_no"), F.col("m.values").alias("v")
    )


def listing_rows(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    reader = {"table": table_rows, "feed": feed_rows}.get(spec.layout, linked_items)
    return reader(pages, spec)


def studies(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """The records a source lists, each once, with their first-seen position."""
    rows = listing_rows(pages, spec).withColumn("pos", position())
    if spec.layout == "table":
        # a page that could not be read is no sign that the listing has ended
        fresh = dedupe.until_repeat(rows, pages.filter("m is not null") if "m" in pages.columns else pages)
        merged = dedupe.merge_by_title(fresh, ["pos"]).withColumnRenamed("first_pos", "pos")
    else:
        merged = dedupe.first_seen(rows, ["source", "source_url"], ["pos"]).withColumn(
            "areas", F.array("area")
        )
    return merged.withColumn("owner", F.lit(spec.owner)).select(*STUDY_COLUMNS)


# --- details --------------------------------------------------------------------------


def block_text(texts: Column) -> Column:
    """Blocks of text: white space collapsed, empties dropped, blank line between."""
    clean = F.filter(F.transform(texts, T.collapse_ws), lambda t: t != "")
    return T.truncate(F.array_join(clean, "\n\n"))


def block_html(blocks: Column, base_url: str) -> Column:
    """Blocks of HTML: trimmed, empties dropped, links made absolute."""
    kept = F.filter(F.transform(blocks, T.trim_ws), lambda h: h != "")
    return U.absolutise_hrefs(F.array_join(kept, "\n\n"), base_url)


def fallback_text(main: Column, heading: Column | None = None) -> Column:
    """Text of a page without blocks: its main part, after the heading if wanted."""
    parts = F.array(*([heading] if heading is not None else []), main)
    clean = F.filter(
        F.transform(parts, lambda t: T.collapse_ws(F.coalesce(t, F.lit("")))), lambda t: t != ""
    )
    return T.truncate(F.array_join(clean, "\n\n"))


def document_links(matches: Column, spec: SourceSpec) -> Column:
    """A page's document links as ``array<struct<title,url,date>>``."""
    tidy = T.trim_ws if spec.plain_titles else T.collapse_ws
    if spec.link_pattern:
        matches = F.filter(
            matches,
            lambda m: F.regexp_like(F.coalesce(m["values"]["href"], F.lit("")), F.lit(spec.link_pattern)),
        )
    links = F.transform(
        matches,
        lambda m: F.struct(
            tidy(m["values"]["title"]).alias("title"),
            F.when(
                F.lit(spec.repeat_links) | (F.coalesce(m["values"]["href"], F.lit("")) != ""),
                U.absolute_url(F.coalesce(m["values"]["href"], F.lit("")), spec.base_url),
            ).alias("url"),
            T.trim_ws(m["values"]["date"]).alias("date"),
        ).cast(DOCUMENT_LINK),
    )
    kept = F.filter(links, lambda x: (x["title"] != "") & (x["url"] != ""))
    return kept if spec.repeat_links else dedupe.first_seen_in(kept, "url")


def details(pages: DataFrame, spec: SourceSpec, hash_fallback: bool = True) -> DataFrame:
    """Description, block HTML, document links and content hash of detail pages.

    ``hash_fallback``: a page with nothing to hash is hashed by its fallback text,
    so that later edits show; False hashes the empty text. A page that could not be
    read has NULL everywhere.
    """
    picked = _matched(pages, spec.detail).select(
        "source",
        "url",
        F.col("m").isNotNull().alias("readable"),
        of_rule("m", "block").alias("blocks"),
        document_links(of_rule("m", "link"), spec).alias("document_links"),
        first_value("m", "heading", "text").alias("heading"),
        first_value("m", "main", "text").alias("main"),
        F.array_join(
            F.concat(*(F.transform(of_rule("m", r), lambda m: m["values"]["html"]) for r in spec.hash_rules)),
            "",
        ).alias("hashed"),
    )
    texts = block_text(F.transform("blocks", lambda b: b["values"]["text"]))
    fallback = fallback_text(F.col("main"), F.col("heading") if spec.heading_first else None)
    html = block_html(F.transform("blocks", lambda b: b["values"]["html"]), spec.base_url)
    described = picked.select(
        "source",
        "url",
        "readable",
        F.coalesce(T.blank_to_null(texts), fallback).alias("description"),
        html.alias("engagement_html"),
        "document_links",
        "hashed",
    )
    hashed = F.array(F.col("hashed"))
    if hash_fallback:
        none = F.col("hashed") == ""
        if spec.hash_links:
            none = none & (F.size("document_links") == 0)
        hashed = F.array(F.when(none, F.col("description")).otherwise(F.col("hashed")))
    return described.select(
        "source",
        "url",
        "description",
        "engagement_html",
        "document_links",
        # an unreadable page has no hash, not that of an empty text
        F.when(
            F.col("readable"), T.content_hash(hashed, F.col("document_links") if spec.hash_links else None)
        ).alias("content_hash"),
    )
