"""Counts over the corpus and over result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.falsy import blank_to_null
from lexmill.functions.json_meta import safe_json_parse
from lexmill.operators.indexing import with_row_index


def corpus_stats(chunks: DataFrame, title: str = "title") -> DataFrame:
    """Number of chunks and of distinct non-empty titles."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct(blank_to_null(F.col(title))).alias("n_titles"),
    )


def distinct_titles(chunks: DataFrame, title: str = "title", position: str = "position") -> DataFrame:
    """``(number, title)``: distinct titles, numbered from 1 as first seen."""
    seen = (
        chunks.where(blank_to_null(F.col(title)).isNotNull())
        .groupBy(title)
        .agg(F.min(position).alias("_first"))
    )
    numbered = with_row_index(seen, ["_first", title], "_index")
    return numbered.select((F.col("_index") + 1).alias("number"), title)


def json_validity(df: DataFrame, text: str, array_key: str = "legaldocuments") -> DataFrame:
    """Adds ``is_valid`` and ``n_documents``, the size of the named array (else null)."""
    parsed = safe_json_parse(F.col(text))
    items = F.try_variant_get(parsed, f"$.{array_key}", "array<variant>")
    return df.withColumn("is_valid", parsed.isNotNull()).withColumn(
        "n_documents", F.when(items.isNotNull(), F.size(items))
    )


def result_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))
