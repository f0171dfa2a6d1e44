"""Lines of a PDF page put together from positioned pieces of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexmill import fixed_values as V
from lexmill.functions.text import js_trim

PIECE = ("down", "x", "at", "w", "str")


def reassemble_pdf_lines(items: DataFrame, position: str = "item") -> DataFrame:
    """``(doc_id, page, text)`` from items ``(doc_id, page, str, x, y, w)``.

    Items go from top to bottom and left to right. A line takes every item
    within the tolerance of its *first* item's height, which makes it a fold
    over the page, not a rule on neighbours. ``position`` keeps items at the
    same place in their given order. A page is the unit of work: what is
    collected is what one sheet holds. A page of blank pieces is an empty line.
    """
    pieces = items.select(
        "doc_id",
        "page",
        (-F.col("y")).alias("down"),
        "x",
        F.col(position).alias("at"),
        "w",
        F.when(js_trim(F.col("str")) != "", F.col("str")).alias("str"),
    )
    runs = _runs(pieces).repartition("doc_id", "page")
    zipped = F.transform(F.collect_list(F.struct(*PIECE)), lambda run: F.arrays_zip(*[run[name].alias(name) for name in PIECE]))
    on_page = F.sort_array(F.filter(F.flatten(zipped), lambda piece: piece["str"].isNotNull()))
    return runs.groupBy("doc_id", "page").agg(_page_text(on_page).alias("text"))


def _runs(pieces: DataFrame) -> DataFrame:
    """One row of lists for neighbouring pieces of one page: half the bytes of rows, and nothing to sort before the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for name in ("doc_id", "page"):
                code = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            edges = pa.array(np.append(starts, batch.num_rows), pa.int32())
            keys = [batch.column(name).take(pa.array(starts)) for name in ("doc_id", "page")]
            yield pa.record_batch(
                [*keys, *[pa.ListArray.from_arrays(edges, batch.column(name)) for name in PIECE]], names=["doc_id", "page", *PIECE]
            )

    kinds = {field.name: field.dataType for field in pieces.schema}
    fields = [StructField(name, kinds[name]) for name in ("doc_id", "page")]
    fields += [StructField(name, ArrayType(kinds[name])) for name in PIECE]
    return pieces.mapInArrow(pack, StructType(fields))


def _page_text(pieces: Column) -> Column:
    """Text of one page's sorted pieces."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("line"),
        F.lit(None).cast("double").alias("anchor"),
        F.lit(None).cast("double").alias("edge"),
    )

    def step(acc: Column, item: Column) -> Column:
        same = F.coalesce(F.abs(item["down"] - acc["anchor"]) <= V.PDF_LINE_TOLERANCE, F.lit(True))
        gap = F.when(item["x"] - acc["edge"] > V.PDF_SPACE_GAP, " ").otherwise("")
        return F.struct(
            F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"),
            F.when(same & acc["edge"].isNotNull(), F.concat(acc["line"], gap, item["str"]))
            .otherwise(item["str"])
            .alias("line"),
            F.when(same, F.coalesce(acc["anchor"], item["down"])).otherwise(item["down"]).alias("anchor"),
            (item["x"] + item["w"]).alias("edge"),
        )

    lines = F.aggregate(pieces, start, step, lambda acc: F.concat(acc["done"], F.array(acc["line"])))
    tidy = F.transform(lines, _tidy)
    return F.concat(F.array_join(F.filter(tidy, lambda line: line != ""), "\n"), F.lit("\n"))


def _tidy(line: Column) -> Column:
    blanks = F.regexp_replace(line, "[ \t]+", " ")
    return F.rtrim(F.replace(blanks, F.lit("\u00A0"), F.lit(" ")), F.lit(V.TRIM_CHARS))
