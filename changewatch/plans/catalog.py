"""Registered queries: the library's operators over the given tables.

Each query runs over whole tables. Where the tables hold no such page, Spark
derives listing pages, feeds or records from their rows, and the equivalent SQL
computes the expected result from the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROWS_PER_PAGE = 100


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table given as one small file, dealt out as landed pages are: reading a page costs more than its size says."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def build_pages(rows: DataFrame, key: str, piece: Column, before: str, after: str, source: str) -> DataFrame:
    """Landed pages of ``ROWS_PER_PAGE`` consecutive keys each, one piece per row."""
    page_no = F.floor(F.col(key) / ROWS_PER_PAGE).cast("int")
    return (
        spread(rows.select(page_no.alias("page_no"), key, piece.alias("piece")), "page_no")
        .groupBy("page_no")
        .agg(F.array_sort(F.collect_list(F.struct(key, "piece"))).alias("p"))
        .select(
            F.lit(source).alias("source"),
            "page_no",
            F.concat(F.lit("p"), "page_no").alias("url"),
            F.concat(
                F.lit(before), F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(after)
            ).alias("body"),
        )
    )


# SQL snippets for the expected results
def sql_decode(x: str) -> str:
    return (
        f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    )


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"


def sql_encode(x: str) -> str:
    """Percent-encode a path; characters a path may hold are put back."""
    out = f"url_encode({x})"
    for code, char in (
        ("2F", "/"), ("2C", ","), ("21", "!"), ("24", "$"), ("26", "&"), ("27", "''"), ("28", "("),
        ("29", ")"), ("2A", "*"), ("2B", "+"), ("3B", ";"), ("3D", "="), ("3A", ":"), ("40", "@"), ("7C", "|"),
    ):
        out = f"replace({out}, '%{code}', '{char}')"
    return out


H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
H1_TITLE = sql_collapse(sql_decode(sql_strip(H1)))
