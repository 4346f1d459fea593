"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One hot url or study must not become one long task: AQE splits the
    # over-sized side of a sort-merge join at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # REBALANCE before partitioned writes also splits over-sized partitions.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "changewatch", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, for functions that run there.

    Spark's own file server hands out the archive, so no folder has to be shared. Not needed
    where the package is installed on all nodes.
    """
    if getattr(spark.sparkContext, "_changewatch_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="changewatch-"), "changewatch.zip")
    with open(path, "wb") as f:  # on the driver, from where it is sent
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._changewatch_shipped = True


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return its folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where that
    is unset a folder of the warehouse is taken, which executors share.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def use_small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session hold at most ``BATCH_ROWS`` rows.

    A batch of whole texts is held several times at once, in the JVM outside its heap and in the Python worker;
    with Spark's 10,000 rows that is hundreds of MB for each executor.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each action go when the action ends.

    For operators of many steps, each of which is a checkpoint or a stored table: else the files of all
    steps lie on the disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
