"""Queries of the manifest, of near copies by one-permutation hashing and of the conversation trie, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import conversation_trie, merkle, near_duplicates
from lexmill.llm.common import table


def _sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: {step}), 4294967295::BIGINT)"


# --- 11: Merkle manifest ---------------------------------------------------------


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; where the id's crc32 is even, the copy under test has lost its line feeds."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    lost = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.audit(docs, {"text": lost})


def _sql_leaf(*columns: str) -> str:
    parts = [f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns]
    return f"sha256({' || '.join(parts)})"


def _sql_tree(name: str, leaves: str) -> str:
    """Relations ``<name>``: all nodes above ``leaves(tree, idx, digest)`` with what stands beside them."""
    run = f"PARTITION BY level, tree, idx // {merkle.FAN_OUT} ORDER BY idx ROWS BETWEEN"
    return f"""
{name}_up(level, tree, idx, digest, n) AS (
  SELECT 0, tree, idx, digest, count(*) OVER (PARTITION BY tree) FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, idx // {merkle.FAN_OUT}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {merkle.FAN_OUT - 1}) // {merkle.FAN_OUT}
  FROM {name}_up WHERE n > 1 GROUP BY level, tree, idx // {merkle.FAN_OUT}, n),
{name} AS (
  SELECT *, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM {name}_up)"""


def _sql_folds(name: str, tree: str, start: str) -> str:
    """Relation ``<name>``: rows ``(row, tree, idx, h, proof)`` of ``start``, folded up to their tree's root."""
    return f"""
{name}_steps(level, row, tree, idx, h, proof) AS (
  SELECT 0, row, tree, idx, h, proof FROM {start}
  UNION ALL
  SELECT s.level + 1, row, s.tree, s.idx // {merkle.FAN_OUT}, sha256(lefts || h || rights), proof || lefts || rights
  FROM {name}_steps s JOIN {tree} t ON t.level = s.level AND t.tree IS NOT DISTINCT FROM s.tree AND t.idx = s.idx WHERE t.n > 1),
{name} AS (SELECT row, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM {name}_steps GROUP BY row)"""


OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_sql_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 2 = 0
      THEN {_sql_leaf("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, source AS tree, leaf AS digest, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs),
{_sql_tree("own", "leaves")},
subroots AS (
  SELECT 0 AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx FROM own WHERE n = 1),
{_sql_tree("whole", "subroots")},
lower_start AS (SELECT row, tree, idx, coalesce(changed, leaf) AS h, '' AS proof FROM leaves),
{_sql_folds("lower_fold", "own", "lower_start")},
upper_start AS (
  SELECT f.row, 0 AS tree, s.idx, f.h, f.proof FROM lower_fold f JOIN leaves l ON l.row = f.row
  JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source),
{_sql_folds("upper_fold", "whole", "upper_start")}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.digest AS verified
FROM upper_fold f JOIN leaves l ON l.row = f.row JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
JOIN whole r ON r.n = 1"""


# --- 12: near duplicates -----------------------------------------------------------


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


_SHINGLE = near_duplicates.SHINGLE_WORDS
OP12_SQL = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - least({_SHINGLE}, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least({_SHINGLE}, len(w)) - 1], ' ')))) AS gram
  FROM doc_words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN sizes ON x = doc_id GROUP BY x, n"""


# --- 13: conversation trie -------------------------------------------------------


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each begun with turns of its family's first."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turn_rows(turns)))


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS pos,
    md5(strlen(role) || ':' || role || text) AS key, strlen(text) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, list({{'key': key, 'bytes': bytes}} ORDER BY pos) AS own, conv_id - conv_id % {conversation_trie.FAMILY} AS base,
    {_sql_crc32("conv_id::VARCHAR")} % {conversation_trie.MOST_BORROWED} AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.own, [])[:c.h] || c.own[c.h + 1:] AS said FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
paths AS (
  SELECT conv_id, d AS depth, d = len(said) AS ends, CASE WHEN d = 0 THEN 0 ELSE said[d].bytes END AS bytes,
    md5(array_to_string(list_transform(said[:d], lambda x: x.key), ' ')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(said[:d - 1], lambda x: x.key), ' ')) END AS up
  FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, node, up, bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, node)),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens
  FROM counted x JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.up"""


QUERIES = {
    "op11_merkle": (op11_merkle, OP11_SQL),
    "op12_near_duplicates": (op12_near_duplicates, OP12_SQL),
    "op13_conversation_trie": (op13_conversation_trie, OP13_SQL),
}
