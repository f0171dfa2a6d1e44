"""Keyword risk rules, scores and the rows of an analysis.

Rules are a short list known when the plan is built, so matching is a
projection: no join, no shuffle, and the text is lower-cased once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import fixed_values as V

RISKS_TYPE = "array<struct<clause:string,issue:string,severity:string>>"


@dataclass(frozen=True)
class RiskRule:
    """Hits when the text holds any of ``keywords``."""

    rule_id: int
    keywords: tuple[str, ...]
    clause: str
    issue: str
    severity: str


DEFAULT_RULES = tuple(RiskRule(*row) for row in V.RISK_RULES)


def _risk(clause: str, issue: str, severity: str) -> Column:
    return F.struct(
        F.lit(clause).alias("clause"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity")
    )


def _hit(lowered: Column, rule: RiskRule) -> Column:
    found = F.lit(False)
    for keyword in rule.keywords:
        found = found | lowered.contains(keyword)
    return F.coalesce(found, F.lit(False))


def match_risk_rules(contracts: DataFrame, rules=DEFAULT_RULES, text: str = "text", key: str = "contract_id") -> DataFrame:
    """``(key, rule_id, clause, issue, severity)``: one row per rule hit."""
    lowered = contracts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _hit(F.col("_text"), rule),
                    F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.clause).alias("clause"),
                             F.lit(rule.issue).alias("issue"), F.lit(rule.severity).alias("severity")),
                )
                for rule in rules
            ]
        )
    )
    exploded = lowered.select(key, F.explode_outer(hits).alias("_hit"))
    return exploded.where(F.col("_hit").isNotNull()).select(key, "_hit.*")


def risk_report(contracts: DataFrame, rules=DEFAULT_RULES, text: str = "text") -> DataFrame:
    """Adds ``n_risks``, ``risk_score`` and ``risks``; no hit gives one Low default."""
    lowered = contracts.withColumn("_text", F.lower(F.coalesce(F.col(text), F.lit(""))))
    found = F.array_compact(
        F.array(*[F.when(_hit(F.col("_text"), rule), _risk(rule.clause, rule.issue, rule.severity)) for rule in rules])
    )
    scored = lowered.withColumn("_found", found).withColumn("n_risks", F.size("_found"))
    n = F.col("n_risks")
    score = F.when(n == 0, V.SCORE_CLEAN).otherwise(
        F.greatest(F.lit(V.SCORE_FLOOR), V.SCORE_CLEAN - n * V.SCORE_STEP)
    )
    risks = F.when(n == 0, F.array(_risk(*V.RISK_NONE))).otherwise(F.col("_found"))
    return scored.withColumn("risk_score", score).withColumn("risks", risks).drop("_text", "_found")


def rules_analysis(contracts: DataFrame, rules=DEFAULT_RULES, text: str = "text") -> DataFrame:
    """The full analysis made from the rules alone: summary, score, risks, advice."""
    return (
        risk_report(contracts, rules, text)
        .drop("n_risks")
        .withColumn("summary", F.lit(V.RULES_SUMMARY))
        .withColumn("recommendation", F.lit(V.RULES_RECOMMENDATION))
    )


def image_analysis() -> dict[str, Column]:
    """The fixed analysis of an image whose text could not be read."""
    return {
        "summary": F.lit(V.IMAGE_SUMMARY),
        "risk_score": F.lit(V.IMAGE_SCORE),
        "risks": F.array(_risk(*V.IMAGE_RISK)),
        "recommendation": F.lit(V.IMAGE_RECOMMENDATION),
    }


def risk_counts(analyses: DataFrame, risks: str = "risks") -> DataFrame:
    """Adds ``n_risks``; a missing list counts as empty."""
    return analyses.withColumn("n_risks", F.coalesce(F.array_size(risks), F.lit(0)))


def risk_items(analyses: DataFrame, keep: list[str], risks: str = "risks") -> DataFrame:
    """One row per listed risk, with its place from 1; none gives a row of nulls."""
    exploded = analyses.select(*keep, F.posexplode_outer(risks).alias("_pos", "_risk"))
    return exploded.select(*keep, (F.col("_pos") + 1).alias("item"), "_risk.*")


def risk_split(df: DataFrame, keep: list[str], score: str = "risk_score") -> DataFrame:
    """Two slices per record: the score, and what it lacks to 100."""
    value = F.coalesce(F.col(score), F.lit(0))
    slices = F.array(
        F.struct(F.lit(V.SLICE_SAFE).alias("name"), value.alias("value")),
        F.struct(F.lit(V.SLICE_RISK).alias("name"), (F.lit(100) - value).alias("value")),
    )
    return df.select(*keep, F.explode(slices).alias("_slice")).select(*keep, "_slice.*")
