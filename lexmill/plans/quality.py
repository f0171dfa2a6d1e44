"""Checks, unique inserts, numbering, upserts and corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.operators import joins, quality, stats
from lexmill.operators.corpus import chunk_documents
from lexmill.operators.corpus import upsert_vectors as upsert
from lexmill.operators.indexing import assign_batches as number_batches
from lexmill.plans.common import DIM, documents, sql_chunks, table
from lexmill.sources.readers import upload_manifest as manifest


def validate_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads, their lines as files of a type given by the ship date's day."""
    day = F.dayofmonth("l_shipdate")
    picture = (F.col("l_orderkey") % 2 == 0) | (day > 20)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"),
        F.when(picture, "p.JPG").when(day > 2, "c.pdf").otherwise("x.exe").alias("name"),
        F.when(picture, "image/jpeg").otherwise("application/pdf").alias("mime"),
    )
    checked = quality.validate_upload(lines)
    return checked.withColumn("error", F.coalesce("error", F.lit("")))


UPLOAD_SQL = f"""
    SELECT l_orderkey AS upload_id, count(*) AS n_files,
      CASE WHEN count(*) > {V.MAX_FILES} THEN '{quality.TOO_MANY}'
        WHEN count(*) > 1 AND NOT bool_and(picture) THEN '{quality.MIXED}'
        WHEN bool_or(NOT picture AND day(l_shipdate) <= 2) THEN '{quality.EXTENSION}' ELSE '' END AS error
    FROM (SELECT *, l_orderkey % 2 = 0 OR day(l_shipdate) > 20 AS picture FROM lineitem) GROUP BY 1"""


def validate_upload_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same uploads at the server, which also takes files by their type: some odd names come as PDF, some as nothing."""
    day = F.dayofmonth("l_shipdate")
    picture = (F.col("l_orderkey") % 2 == 0) | (day > 20)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"),
        F.when(picture, "p.JPG").when(day > 2, "c.pdf").otherwise("x.exe").alias("name"),
        F.when(picture, "image/jpeg").when(day == 1, "application/octet-stream").otherwise("application/pdf").alias("mime"),
    )
    checked = quality.validate_upload(lines, side="server")
    return checked.withColumn("error", F.coalesce("error", F.lit("")))


UPLOAD_SERVER_SQL = UPLOAD_SQL.replace("day(l_shipdate) <= 2", "day(l_shipdate) = 1")


def require_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a user (0 counts as none) or a text, by reason of being kept."""
    events = table(spark, sf_dir, "events").withColumn("text", F.when(F.col("event_type") != "view", F.col("props")))
    valid, rejected = quality.require_fields(events, ["user_id", "text"])
    kept = valid.select("event_id", F.lit("valid").alias("outcome"))
    return kept.unionAll(rejected.select("event_id", F.lit("rejected").alias("outcome")))


def min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = quality.min_length(table(spark, sf_dir, "conversations"), "text", 200, trimmed=True)
    return turns.select("conv_id", "turn", "role")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(documents(spark, sf_dir, "source", "text"), ["source"], content="text", html=False)
    return stats.corpus_stats(chunks, "source")


def distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as titles, in the order of the documents."""
    title = F.substring_index("text", "\n", 1)
    docs = table(spark, sf_dir, "documents").select(title.alias("title"), F.col("doc_id").alias("position"))
    return stats.distinct_titles(docs)


TITLES_SQL = """
    SELECT row_number() OVER (ORDER BY first) AS number, title FROM (
      SELECT split_part(text, chr(10), 1) AS title, min(doc_id) AS first FROM documents GROUP BY 1)
    WHERE title <> ''"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("name"),
        F.concat(
            F.lit("u"), F.floor(F.col("value") * 10), F.when(F.col("event_type") == "error", " @x").otherwise("@x.vn")
        ).alias("email"),
        F.substring("props", 3, 10).alias("password"),
    )


def known_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Id"),
        F.format_string("u%d@x.vn", F.floor(F.abs("c_acctbal")).cast("bigint")).alias("email"),
        F.col("c_name").alias("FullName"),
        F.lit("hidden").alias("Password"),
    )


_REGISTRATIONS = """(SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS name,
      'u' || floor(value * 10)::BIGINT || CASE WHEN event_type = 'error' THEN ' @x' ELSE '@x.vn' END AS email,
      substr(props, 3, 10) AS password FROM events)"""
_KNOWN = "(SELECT c_custkey AS Id, 'u' || floor(abs(c_acctbal))::BIGINT || '@x.vn' AS email, c_name FROM customer)"


def valid_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = quality.validate_register(
        known_users(spark, sf_dir), registrations(spark, sf_dir), ["event_id"]
    )
    columns = ["event_id", "email", "error"]
    return accepted.withColumn("error", F.lit("")).select(columns).unionByName(rejected.select(columns))


REGISTER_SQL = f"""
    WITH c AS (SELECT *, CASE WHEN name = '' THEN 'name' WHEN email LIKE '% %' THEN 'email'
        WHEN length(password) < 6 THEN 'password' END AS bad FROM {_REGISTRATIONS})
    SELECT event_id, email, coalesce(bad, CASE WHEN email IN (SELECT email FROM {_KNOWN}) OR event_id <> first
      THEN 'taken' ELSE '' END) AS error
    FROM (SELECT *, min(CASE WHEN bad IS NULL THEN event_id END) OVER (PARTITION BY email) AS first FROM c)"""


def unique_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sign-up per user, against customers as existing users; the rest conflict."""
    signups = table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    existing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    inserted, conflicts = joins.insert_unique(existing, signups, "user_id", ["ts", "event_id"])
    first = inserted.select("event_id", "user_id", F.lit("inserted").alias("outcome"))
    return first.unionAll(conflicts.select("event_id", "user_id", F.lit("conflict").alias("outcome")))


UNIQUE_SQL = """
    SELECT event_id, user_id, CASE WHEN rn = 1 AND user_id NOT IN (SELECT s_suppkey FROM supplier)
      THEN 'inserted' ELSE 'conflict' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type = 'signup')"""


def users_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.users_by_email(known_users(spark, sf_dir), registrations(spark, sf_dir), "email")


def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written over by two later batches, one of a wrong width, some of them new."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = base.select(
        (F.col("vec_id") * 2).alias("vec_id"), F.reverse("embedding").alias("embedding"), F.lit(1).alias("load")
    )
    again = base.select((F.col("vec_id") * 3).alias("vec_id"), "embedding", F.lit(2).alias("load"))
    short = base.select("vec_id", F.slice("embedding", 1, 3).alias("embedding"), F.lit(3).alias("load"))
    batch = quality.valid_dimension(turned.unionAll(again).unionAll(short), "embedding", DIM)
    merged = upsert(base, batch, "vec_id", ["load"])
    return merged.select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"))


UPSERT_SQL = """
    WITH b AS (
      SELECT vec_id * 2 AS vec_id, embedding[64] AS first, 1 AS load FROM embeddings
      UNION ALL SELECT vec_id * 3, embedding[1], 2 FROM embeddings
      UNION ALL SELECT vec_id, embedding[1], 0 FROM embeddings)
    SELECT vec_id, arg_max(first, load)::DOUBLE AS first FROM b GROUP BY vec_id"""


def assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in upload order, fifty to a batch."""
    chunks = chunk_documents(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], content="text", html=False)
    return number_batches(chunks.select("doc_id", "ordinal"), ["doc_id", "ordinal"])


BATCHES_SQL = f"""
    SELECT doc_id, ordinal, (row_number() OVER (ORDER BY doc_id, ordinal) - 1) // {V.UPSERT_BATCH} AS batch
    FROM ({sql_chunks('documents', 'doc_id', 'text')})"""


def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as uploaded laws and contracts, in one list."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".DOCX", ".json", ".txt")]), F.col("p_size") % 4 + 1)
    files = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("user_id"),
        F.when(F.col("p_brand") != "Brand#2", F.col("p_brand")).otherwise("").alias("title"),
        F.concat("p_name", ext).alias("name"),
        F.concat(F.lit("store/"), "p_partkey").alias("path"),
    )
    taken = manifest(files, "contract").select("file_path", F.col("status").alias("state"))
    return taken.unionAll(manifest(files, "law").select("file_path", F.concat("title", F.lit("/"), "type")))


MANIFEST_SQL = """
    SELECT 'store/' || p_partkey AS file_path, 'pending' AS state FROM part WHERE p_size % 4 IN (0, 1)
    UNION ALL SELECT 'store/' || p_partkey, p_brand || CASE p_size % 4 WHEN 0 THEN '/pdf' ELSE '/json' END
    FROM part WHERE p_size % 4 IN (0, 2) AND p_brand <> 'Brand#2'"""

QUERIES = {
    "validate_upload": (validate_upload, UPLOAD_SQL),
    "validate_upload_server": (validate_upload_server, UPLOAD_SERVER_SQL),
    "require_fields": (
        require_fields,
        "SELECT event_id, CASE WHEN user_id <> 0 AND event_type <> 'view' THEN 'valid' ELSE 'rejected' END AS outcome"
        " FROM events",
    ),
    "min_length": (min_length, "SELECT conv_id, turn, role FROM conversations WHERE length(trim(text)) >= 200"),
    "corpus_stats": (
        corpus_stats,
        f"SELECT count(*) AS n_chunks, count(DISTINCT nullif(source, '')) AS n_titles"
        f" FROM ({sql_chunks('documents', 'source', 'text')})",
    ),
    "distinct_titles": (distinct_titles, TITLES_SQL),
    "valid_register": (valid_register, REGISTER_SQL),
    "unique_register": (unique_register, UNIQUE_SQL),
    "users_by_email": (
        users_by_email,
        f"SELECT min(Id) AS Id, email, arg_min(c_name, Id) AS FullName FROM {_KNOWN}"
        f" WHERE email IN (SELECT email FROM {_REGISTRATIONS}) GROUP BY email",
    ),
    "upsert_vectors": (upsert_vectors, UPSERT_SQL),
    "assign_batches": (assign_batches, BATCHES_SQL),
    "upload_manifest": (upload_manifest, MANIFEST_SQL),
}
