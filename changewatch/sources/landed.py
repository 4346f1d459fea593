"""Landed inputs: pages and JSON feeds as rows, in batch or as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.model import LANDED_AT
from changewatch.session import use_checkpoint_dir

BROADCAST_ROWS = 500_000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages and feeds; partitioned by ``source`` and ``kind`` they are pruned. Files without ``landed_at`` have NULL there."""
    return spark.read.schema(LANDED_AT).parquet(path)


def read_pages_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming twin of :func:`read_pages`: each landed file is read once."""
    return spark.readStream.schema(LANDED_AT).parquet(path)


def page_key() -> list[Column]:
    """What makes rows versions of one page: source, kind and url, and for listings the page number."""
    return [F.col("source"), F.col("kind"), F.col("url"), F.when(F.col("kind") == "listing", F.col("page_no")).alias("page_no")]


def without_rows(df: DataFrame, dropped: DataFrame, same: Column) -> DataFrame:
    """``df`` but for rows that match ``dropped``, a stored frame; few of them are broadcast (they are counted)."""
    rows = dropped.count()
    if rows == 0:
        return df
    return df.join(F.broadcast(dropped) if rows <= BROADCAST_ROWS else dropped, same, "left_anti")


def newest(landed: DataFrame) -> DataFrame:
    """Of each page the version landed last; rows of equal time all stay, and a row without time is older than any other.

    Versions are compared without their texts; only pages with an older version are looked up again.
    """
    if "landed_at" not in landed.columns:
        return landed
    use_checkpoint_dir(landed.sparkSession)
    # a number, so that the aggregate stays in hash tables
    at = F.coalesce(F.unix_micros("landed_at"), F.lit(-(1 << 62)))
    names = ["_source", "_kind", "_url", "_page_no"]
    keys = [k.alias(n) for k, n in zip(page_key(), names, strict=True)]
    versions = landed.select(*keys, at.alias("_at")).groupBy(*names).agg(F.max("_at").alias("_newest"), F.min("_at").alias("_oldest"))
    several = versions.filter("_oldest < _newest").checkpoint()
    same = at < F.col("_newest")
    for key, name in zip(page_key(), names, strict=True):
        same = key.eqNullSafe(F.col(name)) & same
    return without_rows(landed, several, same)


def feed_items(df: DataFrame, json: Column | str, keep: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Explode JSON arrays of objects: one row per item, ``row_no`` in array order.

    Text that is no JSON, or no array, gives no rows. A field that is missing, or
    not text, is NULL. ``keep`` columns are carried along.
    """
    parsed = F.try_parse_json(F.col(json) if isinstance(json, str) else json)
    # an array of variants: one odd element cannot spoil its neighbours
    items = F.try_variant_get(parsed, "$", "array<variant>")
    exploded = df.select(*keep, F.posexplode(items).alias("row_no", "_item")).filter(
        F.col("_item").isNotNull()
    )

    def text(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_item", f"$.{name}", "variant"))
        return F.when(kind == "STRING", F.try_variant_get("_item", f"$.{name}", "string")).alias(name)

    return exploded.select(*keep, "row_no", *(text(f) for f in fields))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources as one frame; ``source_ord`` records the list order."""
    tagged = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged)
