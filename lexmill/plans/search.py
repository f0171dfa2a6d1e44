"""Search, detail and filters, on parts, documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import search as op
from lexmill.operators.stats import result_count as count_of
from lexmill.plans.common import stamp, table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Id"),
        F.col("p_name").alias("Title"),
        F.col("p_type").alias("DocumentType"),
        F.col("p_retailprice").alias("IssueDate"),
    )


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.search_documents(parts(spark, sf_dir), " ring ")


def search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.search_documents(parts(spark, sf_dir), "[r-s]%_OL", mode="like", ignore_case=True)


def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.search_documents_any(table(spark, sf_dir, "documents"), "TION", ("text", "lang", "source"))
    return found.select("doc_id")


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were returned."""
    asked = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("Id"))
    return op.document_detail(parts(spark, sf_dir), asked)


def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kept = op.filter_documents(orders, "F", "1996-01-01", "1998-06-30", kind="o_orderstatus", issued="o_orderdate")
    return kept.select("o_orderkey", stamp("o_orderdate").alias("issued"))


def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_of(op.filter_by_name(table(spark, sf_dir, "customer"), "00", name="c_name"))


_PARTS = "SELECT p_partkey AS Id, p_name AS Title, p_type AS DocumentType, p_retailprice AS IssueDate FROM part"
QUERIES = {
    "search_literal": (search_literal, f"{_PARTS} WHERE contains(p_name, 'ring') OR contains(p_type, 'ring')"),
    "search_like": (
        search_like,
        f"{_PARTS} WHERE regexp_matches(lower(p_name), '[r-s].*.ol') OR regexp_matches(lower(p_type), '[r-s].*.ol')",
    ),
    "search_any": (
        search_any,
        "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(lang), 'tion')"
        " OR contains(lower(source), 'tion')",
    ),
    "document_detail": (
        document_detail,
        f"{_PARTS} WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "filter_range": (
        filter_range,
        "SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS issued FROM orders"
        " WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30'",
    ),
    "result_count": (result_count, "SELECT count(*) AS n FROM customer WHERE contains(lower(c_name), '00')"),
}
