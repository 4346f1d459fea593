"""What the run writes, and what is evaluated for each token of a line."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from changewatch.operators import classify
from changewatch.plans.state import State


def test_tables_of_a_run_are_packed(spark, tmp_path):
    rows = State(spark, str(tmp_path)).write(spark.range(100), "staged", 1)
    files = glob.glob(f"{tmp_path}/staged/run=1/*.parquet")
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
    assert rows.count() == 100


def test_a_line_is_cut_at_its_tokens_once(spark):
    rows = spark.createDataFrame([("May 1, 2025",)], "line string").select(classify._typed_tokens(F.col("line")))
    shown = rows._jdf.queryExecution().analyzed().toString()
    assert 0 <= shown.index("split(") < shown.index("lambdafunction(")
