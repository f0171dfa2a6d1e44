"""Where streams put their rows: one folder per epoch, safe to write again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexmill.session import shared_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_epochs(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts a query whose every batch replaces the folder ``path/epoch=<n>``.

    A batch that is run again after a failure writes the same folder, so each
    row arrives once. ``epoch`` is a partition column when the folder is read.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(store)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
