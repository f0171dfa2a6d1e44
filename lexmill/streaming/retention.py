"""The sweep that removes records which stayed in the trash too long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill import fixed_values as V
from lexmill.operators.history import purge_expired

EVERY = "6 hours"


def ticks(spark: SparkSession) -> DataFrame:
    """A clock: at least one row per trigger."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("ts"))


def retention_sweep(
    clock: DataFrame,
    load: Callable[[], DataFrame],
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    days: int = V.RETENTION_DAYS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """On every tick of ``clock(ts)``, ``store`` gets what ``load`` gives, swept as of the tick.

    ``store`` gets the epoch too, so that it can write a place of its own per
    epoch: a table must not be overwritten while it is read.
    """

    def sweep(batch: DataFrame, epoch: int) -> None:
        as_of = batch.agg(F.max("ts")).first()[0]
        if as_of is not None:
            store(purge_expired(load(), as_of, days), epoch)

    return (
        clock.writeStream.foreachBatch(sweep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": EVERY}))
        .start()
    )
