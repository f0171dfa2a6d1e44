"""Corpus documents chunked and embedded as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexmill import fixed_values as V
from lexmill.operators.corpus import chunk_records
from lexmill.operators.extraction import embed_chunks
from lexmill.operators.joins import last_per_key
from lexmill.streaming.sinks import write_epochs


def stream_ingest(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    embed_fn: Callable[[list[str]], list[list[float]]] | None = None,
    dim: int = V.VECTOR_DIMENSION,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Chunk records of arriving documents, written per epoch.

    No state is kept: a document that comes again is written again, and the
    index is read as the last record per id, by epoch and then by position.
    """
    records = embed_chunks(chunk_records(docs), embed_fn, dim=dim)
    return write_epochs(records.select("id", "values", "metadata", "position"), path, checkpoint, trigger=trigger)


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """``(id, values, metadata)``: the last record per id of all epochs."""
    return last_per_key(spark.read.parquet(path), "id", ["epoch", "position"]).drop("epoch", "position")
