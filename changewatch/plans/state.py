"""Stored state: versioned Parquet tables and one commit record per run.

Each run writes new ``run=N`` folders and, last of all, a commit record. Readers
follow the latest commit, so a run that fails half-way changes nothing; its
folders are overwritten by the next attempt. The snapshot is split into hash
buckets of the record key; a run reads and rewrites the buckets it touches, and
the commit says for each bucket which run holds its current rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch import model

COMMIT = "run int, batch_id bigint, buckets int, bucket int, snapshot_run int"
QUARANTINE = "source string, study_key string, seq bigint, url string, stage string, error string, at timestamp"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class State:
    spark: SparkSession
    root: str
    buckets: int = 64
    run: int = field(init=False, default=0)
    batch_id: int | None = field(init=False, default=None)
    snapshot_runs: dict[int, int] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        commits = self._read("commits", COMMIT)
        if commits is None:
            return
        last = commits.agg(F.max("run")).first()[0]
        # one row per bucket: bounded by the number of buckets
        for row in commits.filter(F.col("run") == last).collect():
            self.run, self.batch_id = row.run, row.batch_id
            # stored rows were placed by this number of buckets
            self.buckets = row.buckets
            if row.bucket is not None:
                self.snapshot_runs[row.bucket] = row.snapshot_run

    # --- reading ------------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as err:
            if err.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def table(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """Committed rows of an append-only table; partitions are pruned."""
        parts = ", run int" + (", bucket int" if "bucket" not in schema else "")
        df = self._read(name, schema + parts)
        if df is None:
            return self.spark.createDataFrame([], schema + parts)
        df = df.filter(F.col("run") <= self.run)
        return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

    def run_table(self, name: str, schema: str, run: int | None = None) -> DataFrame:
        """Rows one run wrote (by default the latest committed run)."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/run={run or self.run}")

    def snapshot(self, buckets: list[int] | None = None) -> DataFrame:
        """Current record of every key, of the given buckets or of all.

        A record whose extraction failed when it was last seen has a NULL hash, so
        the next run takes it as changed and tries again.
        """
        wanted = self.snapshot_runs if buckets is None else {
            b: r for b, r in self.snapshot_runs.items() if b in set(buckets)
        }
        schema = model.SNAPSHOT + ", is_final boolean"
        paths = [f"{self.root}/assessments/run={r}/bucket={b}" for b, r in sorted(wanted.items())]
        if not paths:
            return self.spark.createDataFrame([], model.SNAPSHOT)
        rows = self.spark.read.schema(schema).parquet(*paths).filter("is_final").drop("is_final")
        failed = (
            self.table("quarantine", QUARANTINE)
            .filter(F.col("stage") == "extract")
            .select(F.col("study_key").alias("key"), F.col("at").alias("last_seen_at"))
            .distinct()
            .withColumn("_failed", F.lit(True))
        )
        return (
            rows.join(failed, ["key", "last_seen_at"], "left")
            .withColumn("content_hash", F.when(F.col("_failed").isNull(), F.col("content_hash")))
            .select(*rows.columns)
        )

    def events(self, buckets: list[int] | None = None) -> DataFrame:
        return self.table("events", model.STORED_EVENTS, buckets)

    def documents(self, buckets: list[int] | None = None) -> DataFrame:
        return self.table("documents", model.STORED_DOCUMENTS, buckets)

    # --- writing ------------------------------------------------------------------

    def write(
        self, df: DataFrame, name: str, run: int, by_bucket: bool = False, by: tuple[str, ...] = ()
    ) -> DataFrame:
        """Write one run's rows of a table and read them back, lineage cut."""
        path = f"{self.root}/{name}/run={run}"
        if by_bucket:
            # few, even files per bucket; AQE splits a bucket that is too large
            by, df = ("bucket",), df.hint("rebalance", F.col("bucket"))
        # pages and texts stand in several tables of a run: half the bytes of the default codec
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, run: int, touched: list[int], batch_id: int | None = None) -> None:
        """Publish a run: one small file, written last."""
        current = {**self.snapshot_runs, **{b: run for b in touched}}
        head = (run, batch_id, self.buckets)
        rows = [(*head, b, r) for b, r in sorted(current.items())] or [(*head, None, None)]
        self.spark.createDataFrame(rows, COMMIT).drop("run").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/commits/run={run}")
        self.run, self.batch_id, self.snapshot_runs = run, batch_id, current
