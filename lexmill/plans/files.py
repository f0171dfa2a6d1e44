"""Tables written as files of the kinds that are uploaded or saved, and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.common import table
from lexmill.session import shared_dir
from lexmill.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _corpus_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as corpus JSON, one object per partition of the table."""
    path = _folder(spark, "corpus")
    fields = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("document_type"), F.col("source").alias("title"),
        F.concat(F.lit("/documents/"), "doc_id").alias("source_url"), F.col("text").alias("content"),
    )
    writers.write_json_lists(table(spark, sf_dir, "documents").select(F.to_json(fields).alias("text")), path, readers.CORPUS_KEY)
    return path


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the corpus files, in the byte ranges they were read in; each has a place of its own."""
    read = readers.read_legal_corpus(spark, _corpus_files(spark, sf_dir))
    return read.select("id", "document_type", "title", "source_url", F.md5("content").alias("content"))


CORPUS_SQL = """
    SELECT doc_id::VARCHAR AS id, lang AS document_type, source AS title, '/documents/' || doc_id AS source_url, md5(text) AS content
    FROM documents"""


def corpus_files_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = readers.corpus_validity(spark, _corpus_files(spark, sf_dir))
    return told.agg(F.min("is_valid").alias("is_valid"), F.sum("n_documents").alias("n_documents"))


CORPUS_VALID_SQL = "SELECT true AS is_valid, count(*) AS n_documents FROM documents"


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as the JSON map of a saved index, read back."""
    path = _folder(spark, "index.json")
    entry = F.format_string('"%d":%s', "vec_id", F.to_json("embedding"))
    writers.write_json_lists(table(spark, sf_dir, "embeddings").select(entry.alias("text")), path, readers.INDEX_KEY, "{}")
    read = readers.read_vector_index(spark, path)
    return read.select("vec_id", F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")), " ")).alias("rounded"))


INDEX_SQL = """
    SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT), ' ')) AS rounded
    FROM embeddings"""


QUERIES = {
    "corpus_files": (corpus_files, CORPUS_SQL),
    "corpus_files_valid": (corpus_files_valid, CORPUS_VALID_SQL),
    "index_files": (index_files, INDEX_SQL),
}
