"""Risk rules and the rows of an analysis, on documents as contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions import labels
from lexmill.operators import risk as op
from lexmill.operators import rule_table
from lexmill.operators.extraction import analyze_contracts
from lexmill.operators.quality import drop_analysis_text as drop_text
from lexmill.plans.common import documents, sql_text, table

# The keywords of the default rules do not occur in the test texts.
RULES = (
    op.RiskRule(1, ("ouon",), "clause one", "issue one", "Medium"),
    op.RiskRule(2, ("tion",), "clause two", "issue two", "High"),
    op.RiskRule(3, ("der", "le "), "clause three", "issue three", "Low"),
)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, F.col("doc_id").alias("contract_id"), "text")


_MATCHES = """
    SELECT doc_id AS contract_id, r.* FROM documents JOIN (VALUES
      (1, 'clause one', 'issue one', 'Medium'), (2, 'clause two', 'issue two', 'High'),
      (3, 'clause three', 'issue three', 'Low')) r(rule_id, clause, issue, severity)
    ON CASE rule_id WHEN 1 THEN contains(lower(text), 'ouon') WHEN 2 THEN contains(lower(text), 'tion')
      ELSE contains(lower(text), 'der') OR contains(lower(text), 'le ') END"""


def risk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.match_risk_rules(contracts(spark, sf_dir), RULES)


def rules_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a rule; its keywords are the words no item of a lower id has."""
    word = F.explode(F.split(F.lower("text"), " ")).alias("keyword")
    words = table(spark, sf_dir, "benchmark").select("item_id", word).where("keyword <> ''")
    owners = words.groupBy("keyword").agg(F.min("item_id").alias("rule_id"))
    return owners.select("keyword", "rule_id", F.lit("item").alias("clause"), F.lit("words of an item").alias("issue"), F.lit("Low").alias("severity"))


def risk_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against rules that are a table, with all words of all items as keywords."""
    hits = rule_table.rule_hits(contracts(spark, sf_dir), rules_of_items(spark, sf_dir))
    ids = F.array_sort(F.transform("hits", lambda hit: hit["rule_id"]))
    return hits.select("contract_id", F.size("hits").alias("n_rules"), F.array_join(ids, ",").alias("rule_ids"))


RULE_TABLE_SQL = """
    WITH words AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS keyword FROM benchmark),
    rules AS (SELECT keyword, min(item_id) AS rule_id FROM words WHERE keyword <> '' GROUP BY keyword),
    hits AS (SELECT DISTINCT doc_id, rule_id FROM documents JOIN rules ON contains(lower(text), keyword))
    SELECT d.doc_id AS contract_id, count(rule_id)::INTEGER AS n_rules,
      coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') AS rule_ids
    FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.risk_report(contracts(spark, sf_dir), RULES)


def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = F.array_join(F.transform("risks", lambda risk: risk["clause"]), "; ")
    return reports(spark, sf_dir).select("contract_id", "n_risks", "risk_score", clauses.alias("clauses"))


REPORT_SQL = f"""
    SELECT doc_id AS contract_id, coalesce(n, 0)::INTEGER AS n_risks,
      (CASE WHEN n IS NULL THEN {V.SCORE_CLEAN}
        ELSE greatest({V.SCORE_FLOOR}, {V.SCORE_CLEAN} - {V.SCORE_STEP} * n) END)::INTEGER AS risk_score,
      coalesce(clauses, {sql_text(V.RISK_NONE[0])}) AS clauses
    FROM documents LEFT JOIN (
      SELECT contract_id, count(*) AS n, string_agg(clause, '; ' ORDER BY rule_id) AS clauses
      FROM ({_MATCHES}) GROUP BY 1) ON contract_id = doc_id"""


def risk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed risk with its badge, and the number of risks in its list."""
    counted = op.risk_counts(reports(spark, sf_dir))
    items = op.risk_items(counted, ["contract_id", "n_risks"])
    return items.select(
        "contract_id",
        "n_risks",
        "item",
        "clause",
        labels.severity_badge(F.col("severity")).alias("badge"),
        labels.severity_label(F.col("severity")).alias("label"),
        labels.severity_style(F.col("severity")).alias("style"),
    )


ITEMS_SQL = f"""
    WITH m AS (SELECT contract_id, clause, severity, row_number() OVER (PARTITION BY contract_id ORDER BY rule_id) AS item,
        count(*) OVER (PARTITION BY contract_id) AS n FROM ({_MATCHES})),
    a AS (SELECT * FROM m UNION ALL
      SELECT doc_id, {sql_text(V.RISK_NONE[0])}, {sql_text(V.RISK_NONE[2])}, 1, 1 FROM documents
      WHERE doc_id NOT IN (SELECT contract_id FROM m))
    SELECT contract_id, n::INTEGER AS n_risks, item::INTEGER AS item, clause,
      CASE severity WHEN 'High' THEN {sql_text(V.BADGE_HIGH)} WHEN 'Medium' THEN {sql_text(V.BADGE_MEDIUM)}
        ELSE {sql_text(V.BADGE_OTHER)} END AS badge,
      severity AS label, CASE severity WHEN 'High' THEN 'high' WHEN 'Medium' THEN 'medium' ELSE 'other' END AS style
    FROM a"""


def risk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = reports(spark, sf_dir)
    scored = scored.withColumn("badge", labels.safety_badge(F.col("risk_score")))
    return op.risk_split(scored, ["contract_id", "badge"])


SPLIT_SQL = f"""
    WITH r AS ({REPORT_SQL}), b AS (SELECT *, CASE WHEN risk_score >= {V.SAFE_SCORE} THEN {sql_text(V.BADGE_SAFE)}
      ELSE {sql_text(V.BADGE_RISKY)} END AS badge FROM r)
    SELECT contract_id, badge, {sql_text(V.SLICE_SAFE)} AS name, risk_score AS value FROM b
    UNION ALL SELECT contract_id, badge, {sql_text(V.SLICE_RISK)}, 100 - risk_score FROM b"""


def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of records: safety, severity, date and the name of an image batch."""
    orders = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") % 101)
    camel = F.when(F.col("o_orderstatus") == "P", F.floor("o_totalprice") % 7)
    severity = F.when(F.col("o_orderstatus") != "O", F.substring_index("o_orderpriority", "-", -1))
    issued = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.col("o_orderpriority")
    )
    from lexmill.functions.text import format_date_vi

    return orders.select(
        "o_orderkey",
        labels.safety_badge(score).alias("safety"),
        labels.effective_risk_score(score, camel).alias("score"),
        labels.severity_badge(severity).alias("severity"),
        format_date_vi(issued).alias("issued"),
        labels.display_name(
            F.col("o_orderstatus") == "F", (F.col("o_custkey") % 30).cast("int"), F.lit("a.pdf")
        ).alias("file_name"),
    )


LABELS_SQL = f"""
    WITH o AS (SELECT *, floor(o_totalprice)::BIGINT AS price FROM orders)
    SELECT o_orderkey,
      CASE WHEN o_orderstatus <> 'P' AND price % 101 >= {V.SAFE_SCORE} THEN {sql_text(V.BADGE_SAFE)}
        ELSE {sql_text(V.BADGE_RISKY)} END AS safety,
      CASE WHEN o_orderstatus <> 'P' THEN price % 101 ELSE price % 7 END AS score,
      CASE WHEN o_orderstatus = 'O' OR o_orderpriority LIKE '%-MEDIUM' THEN {sql_text(V.BADGE_MEDIUM)}
        WHEN o_orderpriority LIKE '%-HIGH' THEN {sql_text(V.BADGE_HIGH)} ELSE {sql_text(V.BADGE_OTHER)} END AS severity,
      CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE o_orderpriority END AS issued,
      CASE WHEN o_orderstatus = 'F' THEN printf({sql_text(V.IMAGE_BATCH_NAME)}, o_custkey % 30) ELSE 'a.pdf' END AS file_name
    FROM o"""


def _answer(texts: list[str]) -> list[str]:
    """A stand-in model: JSON for texts that begin in upper case, prose for others."""
    out = []
    for text in texts:
        answer = json.dumps({"summary": "ok", "risk_score": len(text) % 101, "risks": [], "recommendation": "none"})
        out.append(f"```json\n{answer}\n```" if "A" <= text[:1] <= "Z" else "I cannot tell.")
    return out


def model_or_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers where they are JSON, else the rules; images without text apart."""
    texts = contracts(spark, sf_dir).withColumn("is_image", F.length("text") < 400)
    told = analyze_contracts(texts, _answer, rules=RULES, is_image="is_image")
    return told.select("contract_id", "risk_score", "summary", "recommendation", F.size("risks").alias("n_risks"))


MODEL_SQL = f"""
    SELECT contract_id, (CASE WHEN answered THEN length(text) % 101 ELSE risk_score END)::INTEGER AS risk_score,
      CASE WHEN answered THEN 'ok' WHEN blind THEN {sql_text(V.IMAGE_SUMMARY)} ELSE {sql_text(V.RULES_SUMMARY)} END AS summary,
      CASE WHEN answered THEN 'none' WHEN blind THEN {sql_text(V.IMAGE_RECOMMENDATION)}
        ELSE {sql_text(V.RULES_RECOMMENDATION)} END AS recommendation,
      (CASE WHEN answered THEN 0 WHEN blind THEN 1 ELSE greatest(n_risks, 1) END)::INTEGER AS n_risks
    FROM (SELECT r.contract_id, d.text, n_risks, regexp_matches(d.text, '^[A-Z]') AS answered,
        length(trim(d.text)) < 10 AS blind,
        CASE WHEN length(trim(d.text)) < 10 THEN {V.IMAGE_SCORE} ELSE risk_score END AS risk_score
      FROM ({REPORT_SQL}) r JOIN documents d ON d.doc_id = r.contract_id)"""


def drop_analysis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses as stored: the contract's own text taken out of the JSON."""
    analysis = F.struct("n_risks", "risk_score", F.col("text").alias("contract_text"))
    rows = reports(spark, sf_dir).select("contract_id", analysis.alias("analysis"))
    return drop_text(rows).select("contract_id", F.to_json("analysis").alias("stored"))


QUERIES = {
    "risk_matches": (risk_matches, _MATCHES),
    "risk_rule_table": (risk_rule_table, RULE_TABLE_SQL),
    "risk_report": (risk_report, REPORT_SQL),
    "risk_items": (risk_items, ITEMS_SQL),
    "risk_split": (risk_split, SPLIT_SQL),
    "record_labels": (record_labels, LABELS_SQL),
    "model_or_rules": (model_or_rules, MODEL_SQL),
    "drop_analysis_text": (
        drop_analysis_text,
        f"""SELECT contract_id, '{{"n_risks":' || n_risks || ',"risk_score":' || risk_score || '}}' AS stored
        FROM ({REPORT_SQL})""",
    ),
}
