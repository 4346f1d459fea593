"""Sharding by a two-pass external shuffle.

Pass one scatters records over buckets by a seeded hash of key and text; a bucket holds about ``BUCKET_BYTES`` of text, so
one fits into a task's memory whatever the size of the table. Pass two takes the buckets one by one (a task gets many, sorted
by Spark with spill), puts a bucket's records into a fixed order, shuffles it by Fisher-Yates with draws keyed by
seed and bucket, and writes them. Buckets one after the other are so a uniformly random order of all records. It is cut into
shards of consecutive records, whose counts differ by at most one (the law ``rows``).

Equal records (same key and text) are numbered first, so that they scatter as any others: neither a key that repeats nor a
group of copies makes a large bucket. The result depends on the rows, the seed and ``bucket_bytes``, not on how the
table is partitioned; among equal records, which one stands where is left open. Only a record larger than a bucket
makes a bucket larger. Bucket counts are gathered on the driver: 8 bytes for every ``bucket_bytes`` of the table.

Defined cases: a null text counts no bytes (a record's size is its bytes plus one) and scatters as the empty one; null and repeated
keys are records as others; with fewer records than shards some shards are empty; an empty table has no records in any shard.
Whole records are carried as a struct, so columns of any name are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import use_checkpoint_dir
from .catalog import query, stored, table, with_fields
from .places import placed
from .vec import splitmix

SEED = 20
SHARDS = 16
BUCKET_BYTES = 16 << 20


def _numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, text hash, size, copy): records that are alike in key and text have numbers 0, 1, ... as ``copy``."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).cast("string").alias("key"), F.xxhash64(content).alias("text_hash"),
                     (F.octet_length(content).cast("bigint") + 1).alias("size"))
    alike = rows.groupBy("key", "text_hash").agg(F.count("*").alias("count")).filter("count > 1")
    alike = stored(alike.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")))
    if alike.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash"))
    again = rows.join(alike, same, "left_semi").withColumn("_of", F.struct("key", "text_hash").cast("string"))
    counted = placed(again, "_of", []).withColumnRenamed("idx", "copy").drop("_of", "tree", "n")
    return rows.join(alike, same, "left_anti").withColumn("copy", F.lit(0).cast("bigint")).unionByName(counted)


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places; the draws are keyed by seed and bucket."""
    start = splitmix(np.array([seed], np.uint64)) ^ splitmix(np.array([bucket + 1], np.uint64))
    order = list(range(n))
    last = np.arange(n - 1, 0, -1)
    chosen = splitmix(start + last.astype(np.uint64)) % (last + 1).astype(np.uint64)
    for i, j in zip(last.tolist(), chosen.tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(row, size, shard, slot): every record of ``df`` as a struct, with its shard and its place in there.

    For tables of many terabytes choose ``bucket_bytes`` as large as a task's memory allows (a bucket is held three times).
    """
    spark = df.sparkSession
    rows = _numbered(df, key, text)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n, buckets = total[1], max(1, -(-total[0] // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), "key", "text_hash", "copy")
    rows = rows.withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    sizes = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").count().collect():
        sizes[r["bucket"]] = r["count"]
    offsets = np.cumsum(sizes) - sizes
    # consecutive buckets to one task; as many tasks as any other shuffle has
    tasks = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(tasks, F.floor(F.col("bucket") * tasks / buckets).cast("int"))
    ordered = dealt.sortWithinPartitions("bucket", "draw", "key", "text_hash", "copy").select("row", "size", "bucket")

    def written(held: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        order = fisher_yates(whole.num_rows, seed, bucket)
        place = offsets[bucket] + np.arange(len(order))
        whole = whole.take(pa.array(order)).append_column("place", pa.array(place, pa.int64()))
        yield from whole.to_batches(max_chunksize=4096)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], -1
        for batch in batches:
            ids = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if held and ids[begin] != current:
                    yield from written(held, current)
                    held = []
                current = int(ids[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from written(held, current)

    out = ordered.mapInArrow(by_bucket, with_fields(ordered, "place bigint"))
    shard = F.expr(f"(place * {shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return out.withColumn("shard", shard).withColumn("slot", F.col("place") - first).select(
        "row", "size", F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shards of ``df`` to the new folder ``path`` and returns them: (row, size, slot) in a folder per shard,
    the records of each file in the order of their slots."""
    dealt = shuffled(df, **options)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


@query()
def op12_shards(spark, folder):
    docs = table(spark, folder, "documents")
    shards = write_shards(docs, f"{use_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    return shards.select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
