"""Constraint checks, table splits and schema evolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(
    df: DataFrame,
    required: tuple[str, ...] = (),
    enums: dict[str, tuple[str, ...]] | None = None,
    unique: tuple[tuple[str, ...], ...] = (),
) -> DataFrame:
    """Counts of broken constraints: ``check string, n bigint``; zeroes included.

    All row checks are one aggregate. Unique keys are counted per key first, with
    map-side combine, so a repeated key is no hot spot.
    """
    checks: dict[str, Column] = {f"{c} is null": F.col(c).isNull() for c in required}
    for column, values in (enums or {}).items():
        checks[f"{column} not in enum"] = ~F.coalesce(F.col(column).isin(*values), F.lit(True))
    parts = []
    if checks:
        counts = df.agg(*(F.count_if(test).alias(name) for name, test in checks.items()))
        pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n")) for n in checks))
        parts.append(counts.select(F.explode(pairs).alias("c")).select("c.check", "c.n"))
    for key in unique:
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            per_key.agg(F.count_if(F.col("_n") > 1).alias("n")).select(
                F.lit(f"{', '.join(key)} not unique").alias("check"), "n"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def split_documents(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old mixed table -> (events, documents); nothing is lost or repeated."""
    documents = events.filter(F.col("type") == "document").select(
        "study_key",
        F.coalesce("url", F.lit("")).alias("url"),
        F.col("notes").alias("title"),
        F.lit(None).cast("string").alias("published_label"),
        F.coalesce("url", "fingerprint").alias("fingerprint"),
    )
    return events.filter(F.col("type") != "document"), documents


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add missing columns with their default; fill NULLs where one is given."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), value) if name in df.columns else value
            for name, value in defaults.items()
        }
    )


def covering_area(df: DataFrame, area: str, areas: str = "areas") -> DataFrame:
    """Records whose area list holds ``area``."""
    return df.filter(F.array_contains(areas, area))


def between_dates(events: DataFrame, start: str, end: str, column: str = "event_ts") -> DataFrame:
    """Events of a half-open time range; a plain comparison, so files are pruned."""
    return events.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))
