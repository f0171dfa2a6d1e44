"""Shared by the registered queries: table access, stand-ins and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import fixed_values as V

DIM = 64
AS_OF_ORDERS = "2001-08-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ONE_SPLIT = 128 * 1024 * 1024


def spread(scan: DataFrame) -> DataFrame:
    """A table small enough for one split, dealt out to all cores before costly expressions.

    The size is the scan's own estimate. What is moved never exceeds one split,
    whatever the cluster; a larger table is left as it is.
    """
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism) if size <= ONE_SPLIT else scan


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def stamp(col: str | Column) -> Column:
    """A time as text, "" when there is none."""
    return F.coalesce(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


def sql_stamp(expr: str) -> str:
    return f"coalesce(strftime({expr}, '%Y-%m-%d %H:%M:%S.%f'), '')"


def sql_text(value: str) -> str:
    """A Python string as a SQL string expression."""
    parts = ["'" + part.replace("'", "''") + "'" for part in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


TRIM_SQL = "||".join(f"chr({ord(char)})" for char in V.TRIM_CHARS)


def sql_trim(expr: str) -> str:
    return f"trim({expr}, {TRIM_SQL})"


def sql_units(expr: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({expr}) + length(regexp_replace({expr}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def sql_chunks(source: str, keys: str, text: str) -> str:
    """Chunks of ``text`` as rows ``keys, ordinal, text``; short ones dropped."""
    return f"""
    SELECT {keys}, ordinal, text FROM (
      SELECT {keys}, unnest(range(len(chunks)))::INTEGER AS ordinal, unnest(chunks) AS text FROM (
        SELECT {keys}, CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS chunks FROM (
          SELECT {keys}, list_reduce(
            list_transform(
              list_filter(
                list_transform(string_split({text}, chr(10)), lambda l: {sql_trim('l')}),
                lambda l: l <> ''),
              lambda l: {{'done': []::VARCHAR[], 'cur': l, 'n': {sql_units('l')}}}),
            lambda acc, x: CASE
              WHEN acc.n + x.n > {V.CHUNK_MAX_LENGTH}
                THEN {{'done': list_append(acc.done, acc.cur), 'cur': x.cur, 'n': x.n}}
              WHEN acc.cur = '' THEN x
              ELSE {{'done': acc.done, 'cur': acc.cur || ' ' || x.cur, 'n': acc.n + 1 + x.n}} END,
            {{'done': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}}) AS f
          FROM {source})))
    WHERE {sql_units('text')} >= {V.CHUNK_MIN_LENGTH}"""


def sql_cosine(queries: str, corpus: str, k: int = V.TOP_K) -> str:
    """Hits ``query_id, vec_id, score, rank`` of word-count vectors.

    ``queries`` and ``corpus`` are names of relations ``(id, text)``.
    """

    def buckets(name: str) -> str:
        return f"""
        SELECT id, b, count(*) AS n FROM (
          SELECT id, ('0x' || substr(md5(w), 1, 7))::BIGINT % {DIM} AS b
          FROM (SELECT id, unnest(string_split_regex(lower(text), '[\\t-\\r ]+')) AS w FROM {name})
          WHERE w <> '') GROUP BY id, b"""

    return f"""
    WITH qb AS ({buckets(queries)}), cb AS ({buckets(corpus)}),
    qn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM qb GROUP BY id),
    cn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM cb GROUP BY id),
    dots AS (SELECT qb.id AS query_id, cb.id AS vec_id, sum(qb.n * cb.n) AS dot
             FROM qb JOIN cb USING (b) GROUP BY 1, 2),
    scored AS (
      SELECT q.id AS query_id, c.id AS vec_id, round(coalesce(dot / (qn.norm * cn.norm), 0), 12) AS score
      FROM {queries} q CROSS JOIN {corpus} c
      LEFT JOIN dots d ON d.query_id = q.id AND d.vec_id = c.id
      LEFT JOIN qn ON qn.id = q.id LEFT JOIN cn ON cn.id = c.id)
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= {k}"""


# --- the history table and command log that orders and events stand in for ----------


def history(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Orders as history records; ``heavy`` for work on their JSON and texts."""
    orders = table(spark, sf_dir, "orders")
    orders = spread(orders) if heavy else orders
    trashed = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(F.lit(10)))
    title = F.concat(F.lit('{"summary":"s","meta":{"title":"'), "o_orderpriority", F.lit('","kept":1}}'))
    return orders.select(
        F.col("o_orderkey").alias("Id"),
        F.col("o_custkey").alias("UserId"),
        F.format_string("contract_%d.pdf", "o_orderkey").alias("FileName"),
        (F.floor("o_totalprice") % 101).cast("int").alias("RiskScore"),
        F.when(F.col("o_orderstatus") == "P", "broken").otherwise(title).alias("AnalysisJson"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Text of\r\n  "), "o_orderpriority")).alias("ContractText"),
        F.lit(None).cast("string").alias("AnalysisText"),
        F.col("o_orderdate").alias("CreatedAt"),
        F.lit(None).cast("timestamp_ntz").alias("UpdatedAt"),
        trashed.alias("DeletedAt"),
    )


HISTORY_SQL = """(
    SELECT o_orderkey AS Id, o_custkey AS UserId, 'contract_' || o_orderkey || '.pdf' AS FileName,
      (floor(o_totalprice)::BIGINT % 101)::INTEGER AS RiskScore,
      CASE WHEN o_orderstatus = 'P' THEN 'broken'
        ELSE '{"summary":"s","meta":{"title":"' || o_orderpriority || '","kept":1}}' END AS AnalysisJson,
      o_orderpriority,
      CASE WHEN o_orderstatus = 'O' THEN 'Text of' || chr(13) || chr(10) || '  ' || o_orderpriority END AS ContractText,
      o_orderdate::TIMESTAMP AS CreatedAt, NULL::TIMESTAMP AS UpdatedAt,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate::TIMESTAMP + INTERVAL 10 DAY END AS DeletedAt
    FROM orders)"""


def returned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked to be changed: orders with a returned line."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return lines.select(F.col("l_orderkey").alias("Id"))


RETURNED_SQL = "(SELECT DISTINCT l_orderkey AS Id FROM lineitem WHERE l_returnflag = 'R')"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return command_log(events)


def command_log(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    # Patches: some are no JSON, some have an invalid value, some sign or take a signature back; those with a title
    # also have a key that no patch may set.
    patch = (
        F.when(k % 7 == 1, F.lit("broken"))
        .when(k % 5 == 0, F.concat(F.lit('{"pagesImages":[],"title":"'), k, F.lit('"}')))
        .when(k % 11 == 3, F.lit('{"signatureADataUrl":"data:application/pdf;base64,AAAA"}'))
        .when(k % 4 == 2, F.concat(F.lit('{"signatureADataUrl":"data:image/png;base64,AA'), F.lpad(k.cast("string"), 2, "0"), F.lit('"}')))
        .when(k % 4 == 0, F.lit('{"signatureADataUrl":null}'))
        .otherwise(F.concat(F.lit('{"evil":1,"title":"'), k, F.lit('"}')))
    )
    cmd = (
        F.when(kind == "signup", "save")
        .when(kind == "error", "delete")
        .when(kind == "purchase", "restore")
        .when(kind == "click", "patch")
        .when((kind == "view") & (k < 2), "purge")
        .otherwise("read")
    )
    return events.select(
        F.col("user_id").alias("Id"), "ts", F.col("event_id").alias("seq"), cmd.alias("cmd"),
        F.when(cmd == "patch", patch).otherwise(F.col("props")).alias("body"),
    )


PATCH_SQL = """CASE WHEN k % 7 = 1 THEN 'broken' WHEN k % 5 = 0 THEN '{"pagesImages":[],"title":"' || k || '"}'
        WHEN k % 11 = 3 THEN '{"signatureADataUrl":"data:application/pdf;base64,AAAA"}'
        WHEN k % 4 = 2 THEN '{"signatureADataUrl":"data:image/png;base64,AA' || lpad(k::VARCHAR, 2, '0') || '"}'
        WHEN k % 4 = 0 THEN '{"signatureADataUrl":null}' ELSE '{"evil":1,"title":"' || k || '"}' END"""

# ``title`` and ``signature`` are what a patch sets; a signature that is taken back is empty
COMMANDS_SQL = """(
    SELECT *, CASE WHEN cmd = 'patch' AND k % 4 IN (1, 3) THEN k END AS title,
      CASE WHEN cmd = 'patch' AND k % 4 = 2 THEN 'data:image/png;base64,AA' || lpad(k::VARCHAR, 2, '0')
        WHEN cmd = 'patch' AND k % 4 = 0 THEN '' END AS signature
    FROM (
      SELECT *, CASE WHEN event_type = 'signup' THEN 'save' WHEN event_type = 'error' THEN 'delete'
        WHEN event_type = 'purchase' THEN 'restore'
        WHEN event_type = 'click' AND k % 7 = 1 THEN 'refused: invalid JSON'
        WHEN event_type = 'click' AND k % 5 = 0 THEN 'refused: pagesImages'
        WHEN event_type = 'click' AND k % 11 = 3 THEN 'refused: signatureADataUrl'
        WHEN event_type = 'click' THEN 'patch'
        WHEN event_type = 'view' AND k < 2 THEN 'purge' ELSE 'read' END AS cmd
      FROM (SELECT user_id AS Id, ts::TIMESTAMP AS ts, event_id AS seq, event_type, (props->>'$.k')::INTEGER AS k FROM events)))"""
