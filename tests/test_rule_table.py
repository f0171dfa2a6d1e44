"""Rules as a table against a plain search for every keyword."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators.risk import DEFAULT_RULES, match_risk_rules
from lexmill.operators.rule_table import Keywords, match_rule_table, rule_hits

RULES = "keyword string, rule_id bigint, clause string, issue string, severity string"


def rows_of(rules):
    return [(word, rule, f"clause {rule}", None, "Low") for word, rule in rules]


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_against_plain_search(spark, block):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAé \n") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", "AbAbAb", "ab" * 100_000, texts[0]]
    contracts = [(i, text) for i, text in enumerate(texts)] + [(0, texts[0]), (None, "aba")]
    # nested, overlapping, repeated and never found keywords, rules of one and of many keywords
    rules = [("ab", 1), ("aba", 1), ("b", 2), ("bab", 3), ("abab", 4), ("é", 5), ("a b", 6), ("AB", 7), ("ab", 8), ("ab", 8), ("\n\n", 9), (None, 10)]
    rules += [("".join(rng.choice("abé ") for _ in range(rng.randrange(1, 7))), 20 + n % 9) for n in range(80)]
    table = spark.createDataFrame(rows_of(rules), RULES).withColumn("extra", F.lit(1))
    df = spark.createDataFrame(contracts, "contract_id bigint, text string").withColumn("_text", F.lit("x")).withColumn("rule_id", F.lit(0))
    got = Counter((r.contract_id, r.rule_id, r.clause) for r in match_rule_table(df, table, block=block).collect())
    expected = Counter()
    for key, text in contracts:
        lowered = (text or "").lower()
        for rule in {rule for word, rule in rules if word is not None and word in lowered}:
            expected[key, rule, f"clause {rule}"] += 1
    assert got == expected


def test_empty_keyword_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "contract_id bigint, text string")
    always = spark.createDataFrame(rows_of([("", 1), ("x", 1), ("x", 2)]), RULES)
    assert Counter((r.contract_id, r.rule_id) for r in match_rule_table(df, always).collect()) == Counter([(1, 1), (2, 1), (2, 2)])
    none = spark.createDataFrame([], RULES)
    assert [(r.contract_id, r.hits) for r in rule_hits(df, none).orderBy("contract_id").collect()] == [(1, []), (2, [])]
    assert match_rule_table(df.limit(0), always).count() == 0


def test_equals_the_list_form(spark):
    table = spark.createDataFrame([(k, r.rule_id, r.clause, r.issue, r.severity) for r in DEFAULT_RULES for k in r.keywords], RULES)
    texts = [" ".join(r.keywords).upper() for r in DEFAULT_RULES] + [DEFAULT_RULES[0].keywords[0][:-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "contract_id bigint, text string")
    listed = match_risk_rules(df).select("contract_id", "rule_id", "clause", "issue", "severity")
    assert Counter(map(tuple, match_rule_table(df, table).collect())) == Counter(map(tuple, listed.collect()))


def test_time_does_not_follow_the_keywords():
    keywords = Keywords([f"word{n:05}" for n in range(20_000)])
    text = "word00007 " * 50 + "word19999" + " nothing" * 50_000
    assert keywords.rows_in(text) == [7, 19999]
