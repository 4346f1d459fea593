"""Connected components of an edge table, by alternating star contraction.

Every step is a minimum per node (combined before the shuffle) and a join that AQE
may split, so a node with very many neighbours is no single task. Steps are cut by
``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import use_checkpoint_dir


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m"))


def _is_done(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none."""
    ends = edges.select(F.col("u").alias("at"), F.lit(1).alias("out"), F.lit(0).alias("to")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("at").agg(F.sum("out").alias("out"), F.max("to").alias("to"))
    return nodes.filter("out > 1 or (out > 0 and to > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of each node but the roots, v the smallest node of its component; in checkpoint files.

    Edges may repeat and be loops; without any the result is empty.
    """
    use_checkpoint_dir(edges.sparkSession)
    edges = _directed(edges).checkpoint()
    while not _is_done(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_smallest(both), F.col("u") == F.col("at"))
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = _directed(large)
        small = large.join(_smallest(large), F.col("u") == F.col("at"))
        edges = _directed(
            small.select("v", "m").toDF("u", "v").union(small.select("u", "m").toDF("u", "v"))
        ).checkpoint()
    return edges
