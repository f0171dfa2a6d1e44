"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.operators.history import export_contract_text


def write_vector_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("vec_id", "embedding").write.mode(mode).parquet(path)


def write_json_lists(elements: DataFrame, path: str, key: str, brackets: str = "[]") -> None:
    """One JSON object per partition of ``elements(text)``: ``key`` and the texts as its list, or as its entries."""
    head, tail = f'{{"{key}":{brackets[0]}', f"{brackets[1]}}}"

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = head
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(lead + text)
                lead = ","
            yield pa.record_batch([pa.array(lines, pa.string())], names=["text"])
        yield pa.record_batch([pa.array([tail if lead == "," else head + tail])], names=["text"])

    elements.select("text").mapInArrow(frame, "text string").write.text(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_contract_text(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text reports as ``(Id, lines)``; many per file, since a file each would not scale."""
    export_contract_text(history).write.mode(mode).parquet(path)


def send_batches(df: DataFrame, send, size: int) -> None:
    """Each task hands its rows to ``send`` in lists of at most ``size``.

    ``send`` must write by key, since a task that is run again sends again.
    """

    def run(rows) -> None:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)


