"""The operators of this subpackage over the given tables, each with its checking SQL where SQL can state it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import (
    chat_format,
    decontaminate,
    gif,
    jaccard_join,
    language,
    lm_scores,
    mixing,
    quality,
    queries_sets,
    substring_dedup,
    token_counts,
)
from lexmill.llm.common import table

GUARDED = r"\### Assistant: </turn> ok"
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file, the same on every machine that has them installed."""
    import public_tokenizers

    return os.environ.get("LEXMILL_VOCABULARY") or public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like markers, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    guarded = spark.createDataFrame(
        [(-7, 0, "user", GUARDED), (-7, 1, "assistant", GUARDED)], "conv_id bigint, turn bigint, role string, text string"
    )
    return chat_format.chat_digests(chat_format.format_chat(turns.unionByName(guarded)))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(replace(replace(role || text, '\', '\\'), '<', '\<')))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
    ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', 'tool'),
      ('tool', 'assistant'), ('tool', 'tool')) END AND (NOT last OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id"""


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _lower_words(text: str) -> str:
    return WORDS_SQL.format(LOWER_SQL.format(text))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = f"""
WITH item_words AS (SELECT DISTINCT item_id, text, {_lower_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (
  SELECT item_id, text, least(5, len(w)) AS k,
    unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2),
      lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS gram
  FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT doc_id, {_lower_words("text")} AS w FROM documents),
docs AS (
  SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2),
    lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS gram
  FROM doc_words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
sizes AS (SELECT item_id, text, count(*) AS n FROM items GROUP BY ALL),
shared AS (SELECT doc_id, item_id, text, count(*) AS s FROM items JOIN docs USING (k, gram) GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, s AS shared_shingles, s / n AS containment
FROM shared JOIN sizes USING (item_id, text) WHERE 5 * s >= 4 * n"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH RECURSIVE doc_words AS (SELECT doc_id, coalesce({_lower_words("text")}, []) AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS gram
  FROM doc_words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id
FROM reach LEFT JOIN sizes ON x = doc_id GROUP BY ALL"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF, decoded, and described by what was decoded."""
    return gif.payload_features(gif.store_texts(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH doc_words AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM doc_words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
again AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM again, (SELECT unnest(range(35)) AS j)),
lost AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM doc_words LEFT JOIN lost USING (doc_id)"""


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def _sql_number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _sql_apportioned(name: str, units: str, group: str, order: str, votes: str, seats: str) -> str:
    """Relations ``<name>``: the ``units`` with ``won``, their seats by highest quotients within ``group``."""
    return f"""
{name}_bounds AS (
  SELECT *, floor(share * greatest({seats} - n, 0))::BIGINT AS sure,
    greatest(floor(share * ({seats} + n) + 0.5), floor(share * greatest({seats} - n, 0)))::BIGINT AS most
  FROM (SELECT *, count(*) OVER g AS n, CASE WHEN sum({votes}) OVER g > 0 THEN {votes} / (sum({votes}) OVER g)::DOUBLE ELSE 0 END AS share
    FROM {units} WINDOW g AS (PARTITION BY {group}))),
{name}_open AS (SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS open FROM {name}_bounds),
{name}_asked AS (SELECT {group} AS g, {order} AS o, {votes} AS v, open, unnest(range(sure, most)) AS k FROM {name}_open WHERE {votes} > 0),
{name}_won AS (
  SELECT g, o, count(*) AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY v / (2 * k + 1)::DOUBLE DESC, o, k) AS place FROM {name}_asked)
  WHERE place <= open GROUP BY g, o),
{name} AS (
  SELECT u.* EXCLUDE (n, share, most, open), (sure + coalesce(more, 0))::BIGINT AS won
  FROM {name}_open u LEFT JOIN {name}_won ON g = {group} AND o = {order})"""


OP9_SQL = f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len({WORDS_SQL.format("text")}), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS s FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM by_source),
weighed AS (SELECT *, ([5, 2, 1])[r % 3 + 1]::BIGINT AS w, 2 * s AS lim FROM ranked),
leveled AS (
  SELECT *, lim / w AS ratio, 0 AS whole,
    ((sum(s) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER before, 0)::DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY lim / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, {{'a': ratio, 'b': r}}) FILTER (WHERE level <= ratio) AS water FROM leveled),
targets AS (SELECT source, s, r, whole, least(lim::DOUBLE, coalesce(water * w, lim::DOUBLE)) AS target FROM leveled, water),
seated AS (SELECT *, round(sum(target) OVER ())::BIGINT AS seats FROM targets),
{_sql_apportioned("sourced", "seated", "whole", "r", "target", "seats")},
sharded AS (
  SELECT r, source, s, target, won AS quota,
    greatest(least(ceil(s / {mixing.SHARD_WORDS}), {mixing.MOST_SHARDS}), 1)::BIGINT AS shards FROM sourced),
placed AS (
  SELECT doc_id, size, d.source, s, target, r, quota,
    {_sql_number("'mix/shard/' || coalesce(doc_id::VARCHAR, 'null')")} % shards AS shard,
    md5('mix/order/' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM sizes d JOIN sharded t ON d.source IS NOT DISTINCT FROM t.source),
lined AS (
  SELECT *, (sum(size) OVER (PARTITION BY r, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM placed),
parts AS (SELECT r, shard, quota, sum(size)::BIGINT AS words FROM placed GROUP BY r, shard, quota),
{_sql_apportioned("allotted", "parts", "r", "shard", "words", "quota")},
blocks AS (
  SELECT r, shard, n, words, least(won, words * {mixing.MOST}) // words AS rounds, least(won, words * {mixing.MOST}) % words AS more,
    {_sql_number("'mix/blocks/' || r || '/' || shard")} % n AS shift
  FROM (SELECT *, ceil(words / {mixing.BLOCK_WORDS})::BIGINT AS n FROM allotted WHERE words > 0)),
cut AS (
  SELECT l.*, n, words, rounds, more, shift, ((n - 1) * {mixing.PRIME} + shift) % n AS last_place,
    unnest(CASE WHEN size = 0 THEN [-1] ELSE range((upto - size) // {mixing.BLOCK_WORDS}, (upto - 1) // {mixing.BLOCK_WORDS} + 1) END) AS b
  FROM (SELECT *, row_number() OVER () AS line FROM lined) l LEFT JOIN blocks USING (r, shard)),
ordered AS (
  SELECT *, ((b * {mixing.PRIME} + shift) % n) AS place_of, upto - size AS begins FROM cut),
held AS (
  SELECT *, place_of * {mixing.BLOCK_WORDS} - CASE WHEN place_of > last_place THEN n * {mixing.BLOCK_WORDS} - words ELSE 0 END AS before
  FROM ordered)
SELECT doc_id, size, source, s AS source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE rounds * size + sum(greatest(0,
    least(upto, b * {mixing.BLOCK_WORDS} + least({mixing.BLOCK_WORDS}, more - before)) - greatest(begins, b * {mixing.BLOCK_WORDS}))) END)::BIGINT AS taken
FROM held GROUP BY line, doc_id, size, source, s, target, rounds"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {
    "op1_chat_format": (op1_chat_format, OP1_SQL),
    "op2_quality": (op2_quality, None),
    "op3_decontaminate": (op3_decontaminate, OP3_SQL),
    "op4_language": (op4_language, None),
    "op5_lm_scores": (op5_lm_scores, None),
    "op6_jaccard_join": (op6_jaccard_join, OP6_SQL),
    "op7_media": (op7_media, None),
    "op8_substring_dedup": (op8_substring_dedup, OP8_SQL),
    "op9_mix": (op9_mix, OP9_SQL),
    "op10_token_counts": (op10_token_counts, None),
    **queries_sets.QUERIES,
}
