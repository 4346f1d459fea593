"""The run as a stream over a folder of landed pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from changewatch.plans.run import Settings, run
from changewatch.sources.landed import read_pages_stream


def watch(
    spark: SparkSession,
    landed_dir: str,
    state_dir: str,
    checkpoint_dir: str,
    as_of: str | None = None,
    now: datetime | None = None,
    settings: Settings | None = None,
) -> StreamingQuery:
    """Process everything landed since the last call, then stop.

    Each micro-batch is one run. Its batch id is part of the commit, so a batch
    that is replayed after a crash is not applied twice. A listing and its detail
    pages belong in one batch (one set of files); records whose detail page is
    missing are quarantined until their listing lands again. Everything that has landed
    since the last call is one batch, so that no size setting decides what a run sees.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        run(batch, state_dir, as_of, now, settings, batch_id)

    return (
        read_pages_stream(spark, landed_dir)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
