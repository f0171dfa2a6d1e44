"""Risk rules kept as a table: keywords by the ten thousand, found in one walk over each text.

The rules are cut into blocks of bounded bytes. A block becomes an Aho-Corasick
automaton in the task, so the time of a walk does not follow the number of
keywords. Texts are read once and pass all blocks in turn; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = ("rule_id", "clause", "issue", "severity")
BLOCK_BYTES = 1 << 20  # an automaton of at most about 50 MB
ROW_BYTES = 16
HITS_AT_ONCE = 1 << 16


class Keywords:
    """The keywords of a block; ``rows_in`` gives the rows of the block whose keyword a text holds."""

    def __init__(self, keywords: list[str]) -> None:
        rows = defaultdict(list)
        for row, keyword in enumerate(keywords):
            rows[keyword].append(row)
        self._always = rows.pop("", [])  # every text holds the empty keyword
        self._rows = list(rows.values())
        self._automaton = ahocorasick.Automaton()
        for number, keyword in enumerate(rows):
            self._automaton.add_word(keyword, number)
        self._automaton.make_automaton()

    def rows_in(self, text: str) -> list[int]:
        if not self._rows:
            return self._always
        found = set(map(itemgetter(1), self._automaton.iter(text)))
        return [*self._always, *(row for number in sorted(found) for row in self._rows[number])]


def _hits_of_block(texts: DataFrame, rules: pa.Table) -> DataFrame:
    """``texts`` with the rules of one block put behind their ``_hits``, each rule once."""
    schema = T.StructType([*texts.schema.fields, T.StructField("_more", texts.schema["_hits"].dataType)])
    shared = texts.sparkSession.sparkContext.broadcast(rules)  # bounded by the block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.combine_chunks()
        keywords = Keywords(own.column("keyword").to_pylist())
        bodies = own.select(list(RULE)).to_struct_array()
        bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies

        def answered(part: pa.RecordBatch, found: list[list[int]]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found)])
            rows = bodies.take(pa.array([row for rows in found for row in rows], pa.int64()))
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            return pa.record_batch([*part.columns, hits], names=schema.names)

        for batch in batches:
            found, first, held = [], 0, 0
            for row, text in enumerate(batch.column("_text")):
                found.append(keywords.rows_in(text.as_py()))
                held += len(found[-1])
                if held >= HITS_AT_ONCE or row == batch.num_rows - 1:
                    yield answered(batch.slice(first, len(found)), found)
                    found, first, held = [], row + 1, 0

    found = texts.mapInArrow(search, schema)
    return found.withColumn("_hits", F.array_union("_hits", "_more")).drop("_more")


def rule_hits(contracts: DataFrame, rules: DataFrame, text: str = "text", key: str = "contract_id", block: int = BLOCK_BYTES) -> DataFrame:
    """``(key, hits)`` of every contract: the rules of which its lower-cased text holds a keyword, each once.

    ``rules`` has ``keyword`` and ``rule_id, clause, issue, severity``, a row per
    keyword; rows that agree in all four are one rule, and other columns are
    ignored. A keyword is compared as it is, so one with capitals is never found. A
    null keyword is in no text, an empty one in every text, a null text is empty.
    Repeated contracts are answered each. The order of ``hits`` is open.
    """
    listed = rules.where("keyword is not null").select("keyword", *RULE).dropDuplicates()
    weight = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in listed.columns), F.lit(ROW_BYTES))
    total = listed.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block))
    body = T.StructType([listed.schema[name] for name in RULE])
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = contracts.select(F.col(key).alias("_key"), lowered.alias("_text"), F.array().cast(T.ArrayType(body)).alias("_hits"))
    for k in range(blocks):
        out = _hits_of_block(out, listed.where(F.pmod(F.xxhash64(*listed.columns), F.lit(blocks)) == k).toArrow())
    return out.select(F.col("_key").alias(key), F.col("_hits").alias("hits"))


def match_rule_table(contracts: DataFrame, rules: DataFrame, text: str = "text", key: str = "contract_id", block: int = BLOCK_BYTES) -> DataFrame:
    """``(key, rule_id, clause, issue, severity)``: one row per contract and rule hit, as ``match_risk_rules`` gives for a list."""
    hits = rule_hits(contracts, rules, text, key, block)
    return hits.select(key, F.explode_outer("hits").alias("_hit")).where(F.col("_hit").isNotNull()).select(key, "_hit.*")
