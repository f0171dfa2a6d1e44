"""Shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until ``df`` has no column of that name in any case."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and held in the shared checkpoint folder, where a lost executor cannot take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def opened(shared: Any, keep: bool = False) -> Iterator[Any]:
    """In a task: the value of a broadcast, let go afterwards unless ``keep``, so that of many only one is in memory.

    What is no broadcast is its own value.
    """
    if not isinstance(shared, Broadcast):
        yield shared
        return
    yield shared.value
    if not keep:
        vars(shared).pop("_value", None)  # the next one to ask reads it from the executor's disk again


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_array(doc_ids: pa.Array) -> np.ndarray:
    """The same inside a task; a null id is in fold 0."""
    return np.array([0 if i is None else zlib.crc32(str(i).encode()) % 5 for i in doc_ids.to_pylist()], dtype=np.int64)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, to size shards by."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
