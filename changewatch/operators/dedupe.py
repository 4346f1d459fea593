"""De-duplication and merging.

"First seen" and "last wins" are aggregates (min_by, max_by), not windows: they
combine on the map side, so a key that holds a large part of all rows sends one
row per task into the shuffle. ``order`` must be explicit and unique per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.functions.text import let
from changewatch.functions.urls import has_suffixed_url


def _order(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep each key's first row by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _order(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def first_seen_in(links: Column, field: str) -> Column:
    """First-seen distinct inside one array (a page's own links): no shuffle."""
    return let(
        links,
        lambda all_: let(
            F.transform(all_, lambda x: x[field]),
            lambda seen: F.filter(
                all_, lambda x, i: F.array_position(seen, x[field]) == (i + 1).cast("long")
            ),
        ),
    )


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the values of the last row, and ``first_pos``, the place of the first."""
    rest = [c for c in df.columns if c not in keys]
    merged = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), _order(order)).alias("_row"),
        F.min(_order(order)).alias("first_pos"),
    )
    return merged.select(*keys, "_row.*", "first_pos").select(*df.columns, "first_pos")


def until_repeat(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Paged listing that repeats its last page for ever: keep the new rows only.

    A row stays if its url was on no earlier page (repeats inside a page stay), and
    its page comes before the source's first page that adds nothing. ``pages``
    lists every page (source, page_no), so that an empty page also stops.

    The semi-join key holds the page, so an url that every page repeats is spread
    over the pages; its match is one page's rows.
    """
    first = rows.groupBy("source", "source_url").agg(F.min("page_no").alias("page_no"))
    fresh = rows.join(first, ["source", "source_url", "page_no"], "left_semi")
    stop = (
        pages.select("source", "page_no")
        .distinct()
        .join(first.select("source", "page_no").distinct(), ["source", "page_no"], "left_anti")
        .groupBy("source")
        .agg(F.min("page_no").alias("_stop"))
    )
    return (
        fresh.join(stop, "source", "left")
        .filter(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
        .drop("_stop")
    )


def merge_by_title(rows: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per exact title: areas in first-seen order, the canonical url.

    Status and raw status come from the first row; the url is the first one
    without a numeric suffix, else the first. Two steps: rows collapse per
    (title, area) before areas are gathered, so a group never holds more entries
    than it has distinct areas.
    """
    keys = keys or ["source", "title"]
    at = _order(order)
    by_area = (
        rows.withColumn("_plain", ~has_suffixed_url("source_url"))
        .groupBy(*keys, "area")
        .agg(
            F.min(at).alias("_at"),
            F.min_by(F.struct("status", "raw_status", "source_url"), at).alias("_first"),
            F.min_by("source_url", F.when(F.col("_plain"), at)).alias("_plain_url"),
            F.min(F.when(F.col("_plain"), at)).alias("_plain_at"),
        )
    )
    merged = by_area.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("area") != "", F.struct("_at", "area")))
        ).alias("_areas"),
        F.min_by("_first", "_at").alias("_first"),
        F.min_by("_plain_url", "_plain_at").alias("_plain_url"),
        F.min("_at").alias("first_pos"),
    )
    return merged.select(
        *keys,
        F.transform("_areas", lambda a: a["area"]).alias("areas"),
        F.col("_first.status").alias("status"),
        F.col("_first.raw_status").alias("raw_status"),
        F.coalesce("_plain_url", "_first.source_url").alias("source_url"),
        "first_pos",
    )
