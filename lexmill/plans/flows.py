"""The three ways through the library, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions import labels
from lexmill.session import shared_dir
from lexmill.operators import retrieval
from lexmill.operators.corpus import chunk_records, upsert_vectors
from lexmill.operators.extraction import (
    analyze_contracts,
    embed_chunks,
    extract_contract_text,
    readable_contracts,
)
from lexmill.operators.history import save_analysis
from lexmill.operators.risk import DEFAULT_RULES
from lexmill.operators.search import last_question
from lexmill.plans.common import DIM, documents, sql_chunks, sql_cosine, sql_text, sql_trim, table
from lexmill.plans.risk import REPORT_SQL, RULES
from lexmill.plans.text import CHUNK_PAGES_SQL, page_documents

EmbedFn = Callable[[list[str]], list[list[float]]]


def ingest_corpus(
    docs: DataFrame,
    index: DataFrame | None = None,
    embed_fn: EmbedFn | None = None,
    dim: int = V.VECTOR_DIMENSION,
    **options,
) -> DataFrame:
    """Corpus documents as ``(id, values, metadata)``, written over ``index`` when there is one.

    All is narrow up to the upsert, which moves only what shares a key.
    """
    chunks = chunk_records(docs, **options)
    records = embed_chunks(chunks, embed_fn, dim=dim).select("id", "values", "metadata")
    if index is None:
        return records
    if embed_fn is None:
        return upsert_vectors(index, records, keys=chunks.select("id"))
    # Written once: a model is asked once per text, and only what it embeds replaces a record.
    shared_dir(docs.sparkSession)
    return upsert_vectors(index, records.checkpoint())


def ask(
    questions: DataFrame,
    index: DataFrame,
    embed_fn: EmbedFn | None = None,
    k: int = V.TOP_K,
    dim: int = V.VECTOR_DIMENSION,
) -> tuple[DataFrame, DataFrame]:
    """``(prompts, sources)`` for ``questions(query_id, question)``."""
    asked = embed_chunks(questions, embed_fn, text="question", dim=dim).select("query_id", "values")
    hits = retrieval.knn(index, asked, k, dim=dim, corpus_id="id", vector="values")
    told = retrieval.retrieval_view(hits.join(index.select("id", "metadata.*"), "id", "left"))
    prompts = retrieval.build_prompt(questions, retrieval.build_context(told, "chat", questions))
    return prompts, retrieval.source_view(told)


def analyze_uploads(
    files: DataFrame,
    model_fn: Callable[[list[str]], list[str]] | None = None,
    rules=DEFAULT_RULES,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)``: uploaded files read, analysed and made into history rows.

    ``files`` holds ``path, name, kind, content, UserId, RequestedAt``. Files
    that cannot be read or hold too little text are rejected.
    """
    texts = extract_contract_text(files).drop("kind")
    usable, rejected = readable_contracts(texts)
    about = files.select("path", F.col("name").alias("FileName"), "UserId", "RequestedAt")
    analysed = analyze_contracts(usable, model_fn, rules=rules).join(about, "path")
    content = F.to_json(F.struct("summary", "risk_score", "risks", "recommendation"))
    rows, _ = save_analysis(
        analysed.select(
            "UserId",
            "FileName",
            F.col("FileName").alias("OriginalFileName"),
            F.col("risk_score").alias("RiskScore"),
            content.alias("content"),
            F.col("text").alias("contractText"),
            F.lit(None).cast("string").alias("meta"),
            "RequestedAt",
        )
    )
    return rows, rejected.select("path", "error")


# --- registered forms ---------------------------------------------------------------


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "lang", "source", "text").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("position"),
        F.col("source").alias("title"),
        F.col("lang").alias("document_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("text").alias("content"),
    )


def ingest_over_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested over an index of pages, some of whose ids they share."""
    pages = ingest_corpus(page_documents(spark, sf_dir), dim=DIM)
    whole = ingest_corpus(corpus_documents(spark, sf_dir), pages, dim=DIM, html=False)
    return whole.select("id", "metadata.*")


INGEST_SQL = f"""
    WITH new AS (
      SELECT 'doc_' || doc_id || '_chunk_' || ordinal AS id, source AS title, lang AS document_type,
        {sql_text(V.CHUNK_DEFAULTS['source_url'])} AS source_url, text
      FROM ({sql_chunks('documents', 'doc_id, source, lang', 'text')}))
    SELECT * FROM new UNION ALL
    SELECT * FROM ({CHUNK_PAGES_SQL}) old WHERE id NOT IN (SELECT id FROM new)"""


def analyze_and_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents uploaded as text files (French ones misnamed), analysed, as history rows."""
    name = F.concat(F.lit("doc_"), "doc_id", F.when(F.col("lang") == "fr", ".docx").otherwise(".txt"))
    files = documents(spark, sf_dir, "doc_id", "lang", "text").select(
        name.alias("path"),
        name.alias("name"),
        labels.upload_kind(F.lit(""), name).alias("kind"),
        F.encode("text", "utf-8").alias("content"),
        (F.col("doc_id") + 1).alias("UserId"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("RequestedAt"),
    )
    rows, _ = analyze_uploads(files, rules=RULES)
    risks = F.try_variant_get(F.try_parse_json("AnalysisJson"), "$.risks", "array<variant>")
    return rows.select("UserId", "FileName", "RiskScore", "ContractText", F.size(risks).alias("n_risks"))


ANALYZE_SQL = f"""
    SELECT doc_id + 1 AS UserId, 'doc_' || doc_id || '.txt' AS FileName, risk_score AS RiskScore,
      {sql_trim(r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS ContractText,
      greatest(n_risks, 1)::INTEGER AS n_risks
    FROM documents JOIN ({REPORT_SQL}) ON contract_id = doc_id
    WHERE lang <> 'fr' AND length({sql_trim('nfc_normalize(text)')}) >= {V.TEXT_MIN_LENGTH}"""


def ask_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources named for the last message of each conversation, asked against pages."""
    questions = last_question(table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    index = ingest_corpus(page_documents(spark, sf_dir), dim=DIM)
    return ask(questions, index, dim=DIM)[1]


SOURCES_SQL = f"""
    WITH q AS (SELECT conv_id AS id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id),
    pages_index AS ({CHUNK_PAGES_SQL}), c AS (SELECT id, text FROM pages_index)
    SELECT query_id, rank::INTEGER AS rank, title, source_url AS source
    FROM ({sql_cosine('q', 'c')}) h JOIN pages_index p ON p.id = h.vec_id"""

QUERIES = {
    "ask_sources": (ask_sources, SOURCES_SQL),
    "ingest_over_index": (ingest_over_index, INGEST_SQL),
    "analyze_and_save": (analyze_and_save, ANALYZE_SQL),
}
