"""Text clean-up, measuring and chunking, all as JVM expressions except NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill import fixed_values as V

SLICE_BYTES = 1 << 20  # of texts that are strings at once


def js_trim(col: Column) -> Column:
    """Trim Unicode white space and the byte order mark, not only U+0020."""
    return F.btrim(col, F.lit(V.TRIM_CHARS))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units, the unit all size limits are given in."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode NFC. Texts of plain ASCII stay in their Arrow buffer, others become strings a few at a time."""
    return pa.concat_arrays([_composed(part) for part in byte_slices(texts, SLICE_BYTES)] or [texts])


def _composed(texts: pa.Array) -> pa.Array:
    if pc.all(pc.fill_null(pc.string_is_ascii(texts), True)).as_py():
        return texts
    composed = [text and unicodedata.normalize("NFC", text) for text in texts.to_pylist()]
    return pa.array(composed, type=texts.type)


def byte_slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive slices of ``most`` bytes or less, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        last = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, last - at)
        at = last


def strip_html(html: Column) -> Column:
    """Markup to plain lines. An unclosed ``<`` removes the rest of the text."""
    lines = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br" + V.SPACE_CLASS + r"*/?>|</p>|</div>", "\n")
    bare = F.regexp_replace(lines, r"<[^>]*>?", "")
    return js_trim(F.regexp_replace(bare, r"\n" + V.SPACE_CLASS + r"*\n", "\n"))


def _line_ends(text: Column) -> Column:
    composed = nfc(F.coalesce(text, F.lit("")))
    unix = F.replace(F.replace(composed, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(unix, F.lit("\x00"), F.lit(""))


def normalize_text(
    text: Column, strip_blanks: bool = True, collapse_newlines: bool = True, trim: bool = True
) -> Column:
    """NFC, line feeds only, no NUL.

    ``strip_blanks`` removes blanks around line ends and ``collapse_newlines``
    turns three or more line feeds into two.
    """
    out = _line_ends(text)
    if strip_blanks:
        out = F.regexp_replace(F.regexp_replace(out, "(?<![ \t])[ \t]++\n", "\n"), "\n[ \t]+", "\n")
    if collapse_newlines:
        out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return js_trim(out) if trim else out


def normalize_contract_text(text: Column) -> Column:
    return normalize_text(text)


def normalize_pdf_text(text: Column) -> Column:
    return normalize_text(text, strip_blanks=False)


def normalize_docx_text(text: Column) -> Column:
    return normalize_text(text, strip_blanks=False, collapse_newlines=False)


def chunk_text(text: Column, max_length: int = V.CHUNK_MAX_LENGTH) -> Column:
    """Pack trimmed lines into chunks of about ``max_length`` units.

    A line is never split, the joining spaces are not counted against the next
    line, and a first line that is too long leaves an empty chunk before it.
    The running length is carried along, so no text is measured twice.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), js_trim), lambda line: line != "")
    sized = F.transform(lines, lambda line: F.struct(line.alias("line"), utf16_length(line).alias("n")))
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit(0).alias("n"),
    )

    def step(acc: Column, item: Column) -> Column:
        over = (acc["n"] + item["n"]) > max_length
        first = acc["cur"] == ""
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(over | first, item["line"])
            .otherwise(F.concat(acc["cur"], F.lit(" "), item["line"]))
            .alias("cur"),
            F.when(over | first, item["n"]).otherwise(acc["n"] + 1 + item["n"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))

    return F.aggregate(sized, start, step, finish)


def format_date_vi(col: Column) -> Column:
    """``d/M/yyyy``; null gives "", text that is no date is returned as it is."""
    parsed = F.date_format(F.try_to_timestamp(col), "d/M/yyyy")
    return F.when(col.isNull() | (col == ""), F.lit("")).otherwise(F.coalesce(parsed, col))
