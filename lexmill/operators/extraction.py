"""Points where a batch of rows meets code outside Spark: files and models."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from lexmill import fixed_values as V
from lexmill.functions import json_meta as meta
from lexmill.functions.text import js_trim, normalize_contract_text, normalize_docx_text, utf16_length
from lexmill.functions.vectors import hashing_embedding
from lexmill.operators.risk import DEFAULT_RULES, RISKS_TYPE, image_analysis, rules_analysis

ANSWER_FIELDS = ("summary", "risk_score", "risks", "recommendation")
ANSWER_TYPE = f"struct<summary:string,risk_score:int,risks:{RISKS_TYPE},recommendation:string>"

# --- fixed values: names in a DOCX file ---------------------------------------
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX_BODY = "word/document.xml"
ALTERNATE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}AlternateContent"
PROPERTIES = (W + "pPr", W + "rPr", W + "sectPr")


def docx_text(content: bytes) -> str:
    """Paragraph texts of a DOCX body, each followed by an empty line.

    A paragraph inside another (a text box) is a paragraph of its own, after the
    one that holds it. Of alternate content only the first choice is read.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read(DOCX_BODY))
    out: list[str] = []
    waiting = [node for node in [root]]
    while waiting:
        waiting = _paragraphs(waiting.pop(0), out) + waiting
    return "".join(out)


def _paragraphs(node: ElementTree.Element, out: list[str]) -> list[ElementTree.Element]:
    """Writes the paragraph ``node`` and gives the paragraphs in it, or those below a node that is none."""
    inner: list[ElementTree.Element] = []
    parts: list[str] = []
    walk = list(reversed(_children(node)))
    is_paragraph = node.tag == W + "p"
    while walk:
        child = walk.pop()
        if child.tag == W + "p":
            inner.append(child)
        elif child.tag == W + "t":
            parts.append(child.text or "")
        elif child.tag == W + "tab":
            parts.append("\t")
        elif child.tag not in PROPERTIES:
            walk += reversed(_children(child))
    if is_paragraph:
        out.append("".join(parts) + "\n\n")
    return inner


def _children(node: ElementTree.Element) -> list[ElementTree.Element]:
    if node.tag == ALTERNATE:
        return list(node)[:1]
    return list(node)


def _read_docx(content: bytes) -> tuple[str | None, str | None]:
    if not content.startswith(b"PK"):
        return None, "not a DOCX file"
    try:
        return docx_text(content), None
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile) as problem:
        return None, f"unreadable DOCX: {type(problem).__name__}"


def extract_contract_text(files: DataFrame, key: str = "path", style: str = "upload") -> DataFrame:
    """``(key, kind, text, error)`` of files given as ``(key, kind, content)``.

    Text and DOCX are read; other kinds and files whose bytes do not fit their
    kind come back with ``error``. ``style`` picks the clean-up of an uploaded
    file ("upload") or of a stored original ("stored"). Text files are decoded by
    built-ins, bytes that are no UTF-8 replaced; only DOCX files reach Python.
    """
    schema = StructType([files.schema[key]]).add("kind", "string").add("text", "string").add("error", "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # files are large: one at a time
                row = batch.slice(at, 1)
                text, error = _read_docx(row.column("content")[0].as_py() or b"")
                yield pa.record_batch(
                    [row.column(key), row.column("kind"), pa.array([text], pa.string()), pa.array([error], pa.string())],
                    names=schema.names,
                )

    rows = files.select(key, "kind", "content")
    docx = rows.where(F.col("kind") == "docx").mapInArrow(read, schema)
    plain = rows.where(F.col("kind").isNull() | (F.col("kind") != "docx")).select(
        key,
        "kind",
        F.when(F.col("kind") == "txt", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        F.when(F.coalesce(F.col("kind") != "txt", F.lit(True)), F.concat(F.lit("no reader for "), F.coalesce("kind", F.lit("None")))).alias("error"),
    )
    clean = normalize_contract_text if style == "stored" else normalize_docx_text
    return plain.unionByName(docx).select(
        key, "kind", F.when(F.col("text").isNotNull(), clean(F.col("text"))).alias("text"), "error"
    )


def readable_contracts(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(usable, too_short)`` by the trimmed length of the text."""
    usable = F.coalesce(utf16_length(js_trim(F.col(text))) >= V.TEXT_MIN_LENGTH, F.lit(False))
    return texts.where(usable), texts.where(~usable)


def embed_chunks(
    df: DataFrame,
    embed_fn: Callable[[list[str]], list[list[float]]] | None = None,
    text: str = "text",
    dim: int = V.VECTOR_DIMENSION,
    out: str = "values",
) -> DataFrame:
    """Adds a vector per text and drops those of another width than ``dim``.

    ``embed_fn`` gets a batch of texts and is pickled to the tasks. Without one
    a hashed word count stands in; it has nothing of a model's meaning.
    """
    if embed_fn is None:
        return df.withColumn(out, hashing_embedding(F.col(text), dim))
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    # The width is judged where the vector is made: a filter above it would ask the model twice.
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [None if v is None else [float(x) for x in v] for v in embed_fn(batch.column(text).to_pylist())]
            if len(found) != batch.num_rows:
                raise ValueError(f"{len(found)} vectors for {batch.num_rows} texts")
            whole = pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=schema.names)
            yield whole.filter(pa.array([v is not None and len(v) == dim for v in found]))

    return df.mapInArrow(embed, schema)


def _answers(model_fn: Callable[[list[str]], list[str]], texts: list[str]) -> list[str | None]:
    """An answer or null per text. If a batch fails, each of its texts is asked alone:
    a failing service means the fallback for the texts it fails on, not for their neighbours."""
    try:
        answers = list(model_fn(texts))
        if len(answers) == len(texts):
            return answers
    except Exception:  # noqa: BLE001
        pass
    if len(texts) <= 1:
        return [None] * len(texts)
    return [answer for text in texts for answer in _answers(model_fn, [text])]


def analyze_contracts(
    df: DataFrame,
    model_fn: Callable[[list[str]], list[str]] | None = None,
    text: str = "text",
    rules=DEFAULT_RULES,
    is_image: str | None = None,
) -> DataFrame:
    """Adds ``summary, risk_score, risks, recommendation``.

    ``model_fn`` answers a batch of texts with JSON. Rows without a usable
    answer get the analysis of the rules; ``is_image`` names a flag column of
    rows that get the fixed image analysis when their text is too short.
    """
    found = {name: F.col(name) for name in ANSWER_FIELDS}
    if is_image:
        read = F.coalesce(utf16_length(js_trim(F.col(text))) >= V.TEXT_MIN_LENGTH, F.lit(False))
        fixed = image_analysis()
        found = {name: F.when(F.col(is_image) & ~read, fixed[name]).otherwise(col) for name, col in found.items()}
    out = rules_analysis(df, rules, text).withColumns(found)
    if model_fn is None:
        return out

    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series(_answers(model_fn, texts.tolist()), dtype=object)

    body = meta.first_object_text(F.pandas_udf(ask, StringType())(F.col(text)))
    told = out.withColumn("_body", body).withColumn("_told", F.from_json("_body", ANSWER_TYPE))
    usable = F.coalesce(meta.is_valid_json(F.col("_body")), F.lit(False))
    answers = {name: F.when(usable, F.col("_told")[name]).otherwise(F.col(name)) for name in ANSWER_FIELDS}
    return told.withColumns(answers).drop("_body", "_told")
