"""Readers. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions.labels import path_extension, upload_kind
from lexmill.sources import json_ranges

CORPUS_KEY, INDEX_KEY = "legaldocuments", "vectors"
DOCUMENT_FIELDS = "id string, document_type string, title string, source_url string, content string"
DOCUMENT_SCHEMA = (
    "Id int, Title string, SubTitle string, DocumentNumber string, DocumentType string, "
    "Agency string, IssueDate string, Description string, Content string"
)
COMMAND_SCHEMA = "Id bigint, ts timestamp, seq bigint, cmd string, body string"


def read_legal_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(position, id, document_type, title, source_url, content)`` of corpus files.

    ``path`` may name many files, each one JSON object of any size; a file is read
    in byte ranges. ``position`` goes on from file to file, in the order of their
    names, so that documents without an id are told apart. A missing list gives no
    rows; of a repeated one the last counts.
    """
    found = json_ranges.elements(json_ranges.json_parts(spark, path), CORPUS_KEY)
    # One short row per file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("file").agg(F.count("*").alias("_n"))
    starts = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = found.join(F.broadcast(starts), "file")
    return placed.select((F.col("_start") + F.col("position")).alias("position"), F.from_json("text", DOCUMENT_FIELDS).alias("doc")).select("position", "doc.*")


def corpus_validity(spark: SparkSession, path: str) -> DataFrame:
    """``(path, is_valid, n_documents)`` per corpus file, read in byte ranges; an empty file has no row."""
    told = json_ranges.validity(json_ranges.json_parts(spark, path), CORPUS_KEY)
    return told.select(F.col("file").alias("path"), "is_valid", F.col("n_elements").alias("n_documents"))


def read_vector_index(spark: SparkSession, path: str, current: DataFrame | None = None) -> DataFrame:
    """``(vec_id, embedding)`` of a saved index; the parquet form or the JSON map, which is read in byte ranges.

    A JSON file without ``vectors`` leaves ``current`` as it is.
    """
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    parts = json_ranges.json_parts(spark, path, cut="]")
    if current is not None and parts.where((F.col("kind") == "map") & (F.col("text") == INDEX_KEY)).isEmpty():
        return current
    entries = json_ranges.elements(parts, INDEX_KEY).select(F.concat(F.lit("{"), "text", F.lit("}")).alias("text"))
    rows = entries.select(F.explode(F.from_json("text", "map<string,array<double>>")).alias("vec_id", "embedding"))
    return rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>"))


def read_jdbc_table(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """A database table, read in parallel over ranges of ``partition_column``.

    Filters on the result are pushed down by the source.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column and bounds and num_partitions:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(num_partitions),
        )
    return reader.load()


def read_contract_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, name, ext, kind, content)`` of a folder of uploaded files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(
        "path",
        name.alias("name"),
        path_extension(name).alias("ext"),
        upload_kind(F.lit(""), name).alias("kind"),
        "content",
    )


def upload_manifest(files: DataFrame, kind: str) -> DataFrame:
    """Records of accepted uploads: a contract starts as pending, a law keeps its type.

    Contracts hold ``user_id`` and laws hold ``title`` beside ``path`` and ``name``.
    """
    ext = F.substring(path_extension(F.col("name")), 2, 10)
    if kind == "contract":
        kept = files.where(F.col("user_id").isNotNull() & ext.isin("pdf", "doc", "docx"))
        return kept.select("user_id", F.col("path").alias("file_path"), F.lit("pending").alias("status"))
    if kind == "law":
        kept = files.where((F.coalesce("title", F.lit("")) != "") & ext.isin("pdf", "json"))
        return kept.select("title", F.col("path").alias("file_path"), ext.alias("type"))
    raise ValueError(f"unknown kind {kind!r}")


def with_static_fallback(spark: SparkSession, df: DataFrame | None) -> DataFrame:
    """``df``, or the two sample documents when there is no table to read."""
    if df is not None:
        return df
    sample = spark.createDataFrame(list(V.SAMPLE_DOCUMENTS), DOCUMENT_SCHEMA)
    return sample.withColumn("IssueDate", F.to_date("IssueDate"))


def stream_history_commands(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """History commands arriving as files in a folder; times keep their microseconds, zone and fraction are optional."""
    times = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"
    return spark.readStream.schema(COMMAND_SCHEMA).format(fmt).option("timestampFormat", times).load(path)
