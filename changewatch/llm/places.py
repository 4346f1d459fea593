"""Places of rows in a global order, by group, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import stored, with_fields


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with (tree, idx, n): the group's number in ascending order (null first, UTF-8 bytewise), the row's
    place in its group by ``order`` (nulls first), and the group's size; all counted from 0.

    Rows are dealt out by ranges of the whole order, so a group of any size spreads over tasks; rows equal in all of
    it are told apart by a random number (any order of them is as good). A second, small table has one row
    per task and group in it, from which the places of each task's rows follow.
    """
    columns = df.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run, at, last = -1, 0, None
        for batch in batches:
            runs, ats = [], []
            for value in batch.column(columns.index(group)).to_pylist():
                if run < 0 or value != last:
                    run, at, last = run + 1, 0, value
                runs.append(run)
                ats.append(at)
                at += 1
            extra = [pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(ats, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *extra], names)

    names = [*columns, "_part", "_run", "_at"]
    keys = [group, *order, "_tie"]
    in_order = df.withColumn("_tie", F.rand(11)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    rows = stored(in_order.mapInArrow(numbered, with_fields(df, "_part int, _run bigint, _at bigint")))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_part", "_run", group).agg(F.count("*").alias("_count")).select(
        "*",
        F.sum("_count").over(of_group).alias("n"),
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"),
        F.min("_part").over(of_group).alias("_first"),
    )
    runs = stored(runs)
    # a group is numbered where it starts: groups started by earlier tasks (a row per task), then those of its own
    begun = runs.filter("_part = _first")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    started = begun.groupBy("_part").agg(F.count("*").alias("_groups")).select(
        "_part", F.coalesce(F.sum("_groups").over(earlier), F.lit(0)).alias("_earlier"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_run")) - 1
    trees = begun.withColumn("_own", own).join(started, "_part").select(
        F.col(group).alias("_group"), (F.col("_earlier") + F.col("_own")).cast("bigint").alias("tree"))
    runs = stored(runs.join(trees, F.col(group).eqNullSafe(F.col("_group"))).select("_part", "_run", "_before", "n", "tree"))
    return rows.join(runs, ["_part", "_run"]).select(*columns, "tree", (F.col("_before") + F.col("_at")).alias("idx"), "n")
