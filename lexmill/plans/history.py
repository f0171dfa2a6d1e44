"""The history table (orders stand in) and its command log (events stand in)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from lexmill import fixed_values as V
from lexmill.functions.binding import expand, let
from lexmill.functions.json_meta import meta_text, parsed_view, safe_json_parse
from lexmill.operators import history as op
from lexmill.operators.extraction import extract_contract_text
from lexmill.operators.fold import fold_history
from lexmill.operators.joins import update_by_key as update_rows
from lexmill.operators.search import filter_by_name
from lexmill.plans.common import (
    AS_OF_EVENTS,
    AS_OF_ORDERS,
    COMMANDS_SQL,
    HISTORY_SQL,
    RETURNED_SQL,
    commands,
    history,
    returned_ids,
    sql_stamp,
    spread,
    sql_text,
    stamp,
    table,
)

DATES = ("CreatedAt", "UpdatedAt", "DeletedAt")


def state(df: DataFrame) -> DataFrame:
    return df.select("Id", *[stamp(name).alias(name) for name in DATES])


def sql_state(source: str) -> str:
    return f"SELECT Id, {', '.join(f'{sql_stamp(name)} AS {name}' for name in DATES)} FROM {source}"


def history_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.list_history(history(spark, sf_dir)).select("Id", "UserId", stamp("CreatedAt").alias("CreatedAt"))


def history_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.list_trash(history(spark, sf_dir)).select("Id", "UserId", stamp("DeletedAt").alias("DeletedAt"))


USER = 7


def _newest_first(df: DataFrame, by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("UserId").orderBy(F.desc(by), F.desc("Id")))
    return df.select("Id", stamp(by).alias(by), place.alias("place"))


def history_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's records with their place; the user is a filter of the scan."""
    return _newest_first(op.list_history(history(spark, sf_dir), USER), "CreatedAt")


def trash_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest_first(op.list_trash(history(spark, sf_dir), USER), "DeletedAt")


def _sql_of_user(by: str, trashed: str) -> str:
    return f"""
    SELECT Id, {sql_stamp(by)} AS {by}, row_number() OVER (ORDER BY {by} DESC, Id DESC)::INTEGER AS place
    FROM {HISTORY_SQL} WHERE UserId = {USER} AND DeletedAt IS {trashed}"""


def older_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from before the trash was introduced, read like a present one."""
    old = history(spark, sf_dir).drop("DeletedAt", "UpdatedAt")
    return state(op.list_history(op.ensure_columns(old, {name: TimestampType() for name in ("UpdatedAt", "DeletedAt")})))


def history_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(op.history_detail(history(spark, sf_dir), returned_ids(spark, sf_dir)))


def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as listed, those with a 7 in their name."""
    shown = filter_by_name(op.record_view(history(spark, sf_dir)), "_7")
    return shown.withColumn("deleted_at", stamp("deleted_at"))


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(op.soft_delete(history(spark, sf_dir), returned_ids(spark, sf_dir), AS_OF_ORDERS))


def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(op.restore(history(spark, sf_dir), returned_ids(spark, sf_dir), AS_OF_ORDERS))


def purge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(op.purge(history(spark, sf_dir), returned_ids(spark, sf_dir)))


def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(op.purge_expired(history(spark, sf_dir), AS_OF_ORDERS))


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned orders that a delete does not find: they are in the trash already."""
    return op.missing_ids(history(spark, sf_dir), returned_ids(spark, sf_dir), active_only=True)


def save_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click"))
    content = F.when(F.col("event_type") == "signup", F.concat(F.lit('{"meta":{"k":0,"old":1},"s":'), F.col("value"), F.lit("}")))
    return events.select(
        F.col("user_id").alias("UserId"),
        F.when(F.col("value") >= 5, F.format_string("f%d.txt", "event_id")).otherwise("").alias("FileName"),
        (F.floor("value") % 101).alias("RiskScore"),
        content.alias("content"),
        F.col("props").alias("meta"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("a \r\n"), "props")).otherwise(" ").alias("contractText"),
        F.col("ts").alias("RequestedAt"),
        "event_id",
    )


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.save_analysis(save_requests(spark, sf_dir))[0]


def save_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves as rows; user 0 and nameless files are turned away."""
    rows = saved(spark, sf_dir)
    return rows.select(
        "UserId", "FileName", "RiskScore", "ContractText", "IsFinal", stamp("CreatedAt").alias("CreatedAt"),
        F.get_json_object("AnalysisJson", "$.meta.k").alias("k"),
        F.coalesce(F.get_json_object("AnalysisJson", "$.meta.old"), F.lit("")).alias("old"),
    )


_SAVES = f"""(SELECT user_id AS UserId, 'f' || event_id || '.txt' AS FileName, event_id, ts::TIMESTAMP AS ts,
      (floor(value)::BIGINT % 101)::INTEGER AS RiskScore, event_type, props FROM events
    WHERE event_type IN ('signup', 'click') AND value >= 5 AND user_id <> 0)"""
SAVE_SQL = f"""
    SELECT UserId, FileName, RiskScore,
      CASE WHEN event_type = 'signup' THEN 'a' || chr(10) || props ELSE '' END AS ContractText,
      1 AS IsFinal, {sql_stamp('ts')} AS CreatedAt, props->>'$.k' AS k,
      CASE WHEN event_type = 'signup' THEN '1' ELSE '' END AS old
    FROM {_SAVES}"""


def saves_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves without a user or a file name."""
    return op.save_analysis(save_requests(spark, sf_dir))[1].select("event_id")


SAVES_REJECTED_SQL = """
    SELECT event_id FROM events WHERE event_type IN ('signup', 'click') AND (value < 5 OR user_id = 0)"""


def append_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows with the numbers they get after the highest Id."""
    _, inserted = op.append_history(history(spark, sf_dir), saved(spark, sf_dir), ["CreatedAt", "FileName"])
    return inserted.withColumn("AnalysisAt", stamp("AnalysisAt"))


APPEND_SQL = f"""
    SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, FileName) AS Id,
      UserId, FileName, RiskScore, {sql_stamp('ts')} AS AnalysisAt
    FROM {_SAVES}"""


def meta_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch per line item; the discount decides what it sets and whether it is valid."""
    box = '{"x":0.1,"y":0.2,"w":%s,"h":0.1}'
    place = F.format_string(
        '{"signaturePlacement":{"pageIndex":0,"a":' + box + ',"b":' + box + "}}",
        (F.col("l_linenumber") / 4).cast("string"),
        F.lit("0.3"),
    )
    named = F.format_string('{"title":"t%d","description":null,"other":1}', "l_linenumber")
    step = F.round(F.col("l_discount") * 100).cast("int")
    body = (
        F.when(step % 3 == 0, place)
        .when(step % 3 == 1, named)
        .otherwise(F.format_string('{"category":"c%d","pagesOriginalNames":["a",%s]}', "l_linenumber",
                                   F.when(F.col("l_linestatus") == "F", '"b"').otherwise("2")))
    )
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_linestatus")
    return spread(table(spark, sf_dir, "lineitem").select(*names)).select(
        F.col("l_orderkey").alias("Id"), body.alias("patch"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def update_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated, _ = op.update_meta(history(spark, sf_dir, heavy=True), meta_patches(spark, sf_dir), AS_OF_ORDERS)
    told = let(
        safe_json_parse(F.col("AnalysisJson")),
        lambda parsed: F.struct(
            parsed_view(parsed, F.col("FileName")).alias("view"),
            F.coalesce(meta_text(parsed, "signaturePlacement.a.w"), F.lit("")).alias("width"),
            F.coalesce(meta_text(parsed, "kept"), F.lit("")).alias("kept"),
        ),
    )
    viewed = expand(updated, ["Id", "UpdatedAt"], told)
    return viewed.select("Id", "view.title", "view.category", "width", "kept", stamp("UpdatedAt").alias("UpdatedAt"))


_META_PATCHES = """(
    SELECT *, CASE kind WHEN 0 THEN l_linenumber <= 3 WHEN 1 THEN true ELSE l_linestatus = 'F' END AS valid,
      {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice} AS seq
    FROM (SELECT *, round(l_discount * 100)::INTEGER % 3 AS kind FROM lineitem))"""
UPDATE_META_SQL = f"""
    WITH p AS (SELECT l_orderkey AS Id,
        arg_max('t' || l_linenumber, seq) FILTER (WHERE kind = 1) AS title,
        arg_max('c' || l_linenumber, seq) FILTER (WHERE kind = 2) AS category,
        arg_max((l_linenumber / 4)::VARCHAR, seq) FILTER (WHERE kind = 0) AS width
      FROM {_META_PATCHES} WHERE valid GROUP BY 1)
    SELECT h.Id,
      coalesce(p.title, CASE WHEN h.AnalysisJson <> 'broken' THEN o_orderpriority END, FileName) AS title,
      coalesce(p.category, '') AS category, coalesce(p.width, '') AS width,
      CASE WHEN h.AnalysisJson <> 'broken' THEN '1' ELSE '' END AS kept,
      CASE WHEN p.Id IS NULL THEN '' ELSE '{AS_OF_ORDERS}.000000' END AS UpdatedAt
    FROM {HISTORY_SQL} h LEFT JOIN p USING (Id)"""


def rejected_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that were refused, with the key at fault."""
    _, rejected = op.update_meta(history(spark, sf_dir, heavy=True), meta_patches(spark, sf_dir), AS_OF_ORDERS)
    return rejected.groupBy("Id", "error").agg(F.count("*").alias("n"))


REJECTED_SQL = f"""
    SELECT l_orderkey AS Id, CASE kind WHEN 0 THEN 'signaturePlacement' ELSE 'pagesOriginalNames' END AS error,
      count(*) AS n
    FROM {_META_PATCHES} WHERE NOT valid GROUP BY 1, 2"""


def signature_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders get signatures; medium ones offer a PDF and are refused, low ones clear B."""
    url = F.when(F.col("o_orderpriority") == "3-MEDIUM", "data:application/pdf;base64,AAAA").otherwise("data:image/png;base64,AAAA")
    b = F.when(F.col("o_orderpriority") == "5-LOW", "null").otherwise('"data:image/jpg;base64,BBBB"')
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Id"),
        F.format_string('{"signatureADataUrl":"%s","signatureBDataUrl":%s}', url, b).alias("patch"),
        F.lit(1).alias("seq"),
    )


def update_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated, _ = op.update_signatures(history(spark, sf_dir, heavy=True), signature_patches(spark, sf_dir), AS_OF_ORDERS)

    def held(key: str) -> F.Column:
        return F.coalesce(F.get_json_object("AnalysisJson", f"$.meta.{key}"), F.lit("")).alias(key[:10])

    return updated.select("Id", held("signatureADataUrl"), held("signatureBDataUrl"), stamp("UpdatedAt").alias("UpdatedAt"))


SIGNATURES_SQL = f"""
    SELECT Id, CASE o_orderpriority WHEN '3-MEDIUM' THEN '' ELSE 'data:image/png;base64,AAAA' END AS signatureA,
      CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN '' ELSE 'data:image/jpg;base64,BBBB' END AS signatureB,
      CASE o_orderpriority WHEN '3-MEDIUM' THEN '' ELSE '{AS_OF_ORDERS}.000000' END AS UpdatedAt
    FROM {HISTORY_SQL}"""


def signatures_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, refused = op.update_signatures(history(spark, sf_dir, heavy=True), signature_patches(spark, sf_dir), AS_OF_ORDERS)
    return refused.select("Id", "error")


def update_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances for numbers of which only some are users'."""
    orders = table(spark, sf_dir, "orders")
    patch = orders.groupBy((F.col("o_custkey") * 2).alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return update_rows(table(spark, sf_dir, "customer"), patch, "c_custkey")[1]


def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users take over the balance of their dearest order as their new balance."""
    orders = table(spark, sf_dir, "orders")
    patch = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    updated, _ = update_rows(table(spark, sf_dir, "customer"), patch, "c_custkey")
    return updated.select("c_custkey", "c_name", "c_acctbal")


def backfill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without text filled from an original file kept as a data URL."""
    base = history(spark, sf_dir)
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode(F.concat(F.lit(" from "), "FileName"), "utf-8")))
    packed = F.format_string('{"meta":{"originalFileDataUrl":"%s"}}', url)
    base = base.withColumn("AnalysisJson", F.when(F.col("RiskScore") >= 50, packed).otherwise(F.col("AnalysisJson")))
    files = op.original_files(base).withColumn("kind", F.lit("txt"))
    texts = extract_contract_text(files, "Id", "stored")
    filled = op.backfill_contract_text(base, texts, AS_OF_ORDERS)
    return filled.select("Id", F.coalesce("ContractText", F.lit("")).alias("text"), stamp("UpdatedAt").alias("UpdatedAt"))


BACKFILL_SQL = f"""
    SELECT Id, coalesce(ContractText, CASE WHEN RiskScore >= 50 THEN 'from ' || FileName END, '') AS text,
      CASE WHEN ContractText IS NULL AND RiskScore >= 50 THEN '{AS_OF_ORDERS}.000000' ELSE '' END AS UpdatedAt
    FROM {HISTORY_SQL}"""


def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.export_contract_text(history(spark, sf_dir, heavy=True))


EXPORT_SQL = f"""
    SELECT Id, CASE WHEN AnalysisJson <> 'broken' THEN o_orderpriority ELSE FileName END || chr(10)
      || {sql_text(V.EXPORT_CREATED)} || strftime(CreatedAt, '%H:%M:%S %-d/%-m/%Y') || chr(10)
      || {sql_text(V.EXPORT_HEADING)} || chr(10)
      || CASE WHEN ContractText IS NULL THEN {sql_text(V.EXPORT_EMPTY)} ELSE 'Text of' || chr(10) || o_orderpriority END
      AS lines
    FROM {HISTORY_SQL}"""


def folded(df: DataFrame) -> DataFrame:
    def held(key: str) -> F.Column:
        return F.coalesce(F.get_json_object("AnalysisJson", f"$.meta.{key}"), F.lit(""))

    dates = [stamp(name).alias(name) for name in DATES]
    return df.select("Id", *dates, held("title").alias("title"), held("signatureADataUrl").alias("signature"), held("evil").alias("evil"))


def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = fold_history(commands(spark, sf_dir), AS_OF_EVENTS)
    return folded(records)


def history_fold_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's patches that have no effect, with what is wrong."""
    _, refused = fold_history(commands(spark, sf_dir), AS_OF_EVENTS)
    return refused.select("Id", "seq", "error")


FOLD_REFUSED_SQL = f"""
    SELECT Id, seq, substr(cmd, 10) AS error FROM {COMMANDS_SQL} WHERE starts_with(cmd, 'refused')"""

FOLD_SQL = f"""
    WITH log AS (SELECT *, {{'ts': ts, 'seq': seq}} AS pos FROM {COMMANDS_SQL} WHERE cmd <> 'read' AND NOT starts_with(cmd, 'refused')),
    first AS (SELECT Id, min(pos) AS born FROM log WHERE cmd = 'save' GROUP BY Id),
    later AS (SELECT l.*, f.born FROM log l JOIN first f USING (Id) WHERE l.pos > f.born),
    flips AS (SELECT *, lag(cmd) OVER w AS before,
        min(CASE WHEN cmd = 'restore' THEN ts END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back
      FROM later WHERE cmd IN ('delete', 'restore') WINDOW w AS (PARTITION BY Id ORDER BY pos)),
    effective AS (SELECT * FROM flips WHERE cmd = 'restore' OR before IS NULL OR before = 'restore'),
    ends AS (SELECT Id, max(ts) AS moved,
        arg_max(cmd, pos) AS last_cmd, arg_max(ts, pos) AS last_ts,
        bool_or(cmd = 'delete' AND back > ts + INTERVAL {V.RETENTION_DAYS} DAY) AS swept
      FROM effective GROUP BY Id),
    patches AS (SELECT Id, max(ts) AS patched, arg_max(title, pos) AS title, arg_max(signature, pos) AS signature
      FROM later WHERE cmd = 'patch' GROUP BY Id),
    final AS (SELECT f.Id, f.born.ts AS CreatedAt, greatest(e.moved, p.patched) AS UpdatedAt,
        CASE WHEN e.last_cmd = 'delete' THEN e.last_ts END AS DeletedAt, p.title, p.signature
      FROM first f LEFT JOIN ends e USING (Id) LEFT JOIN patches p USING (Id)
      WHERE f.Id NOT IN (SELECT Id FROM later WHERE cmd = 'purge') AND coalesce(e.swept, false) = false)
    SELECT Id, {', '.join(f'{sql_stamp(name)} AS {name}' for name in DATES)},
      coalesce(title::VARCHAR, '') AS title, coalesce(signature, '') AS signature, '' AS evil
    FROM final
    WHERE DeletedAt IS NULL OR DeletedAt >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL {V.RETENTION_DAYS} DAY"""

_IN = f"Id IN (SELECT Id FROM {RETURNED_SQL})"
_NOW = f"TIMESTAMP '{AS_OF_ORDERS}'"
QUERIES = {
    "history_active": (
        history_active,
        f"SELECT Id, UserId, {sql_stamp('CreatedAt')} AS CreatedAt FROM {HISTORY_SQL} WHERE DeletedAt IS NULL",
    ),
    "history_trash": (
        history_trash,
        f"SELECT Id, UserId, {sql_stamp('DeletedAt')} AS DeletedAt FROM {HISTORY_SQL} WHERE DeletedAt IS NOT NULL",
    ),
    "history_of_user": (history_of_user, _sql_of_user("CreatedAt", "NULL")),
    "trash_of_user": (trash_of_user, _sql_of_user("DeletedAt", "NOT NULL")),
    "older_table": (
        older_table,
        f"SELECT Id, {sql_stamp('CreatedAt')} AS CreatedAt, '' AS UpdatedAt, '' AS DeletedAt FROM {HISTORY_SQL}",
    ),
    "history_detail": (history_detail, sql_state(f"{HISTORY_SQL} WHERE {_IN}")),
    "record_view": (
        record_view,
        f"SELECT Id AS id, FileName AS name, strftime(CreatedAt, '%-d/%-m/%Y') AS date, RiskScore AS risk_score,"
        f" {sql_stamp('DeletedAt')} AS deleted_at FROM {HISTORY_SQL} WHERE contains(FileName, '_7')",
    ),
    "soft_delete": (
        soft_delete,
        sql_state(
            f"(SELECT Id, CreatedAt, CASE WHEN {_IN} AND DeletedAt IS NULL THEN {_NOW} ELSE UpdatedAt END AS UpdatedAt,"
            f" CASE WHEN {_IN} AND DeletedAt IS NULL THEN {_NOW} ELSE DeletedAt END AS DeletedAt FROM {HISTORY_SQL})"
        ),
    ),
    "restore": (
        restore,
        sql_state(
            f"(SELECT Id, CreatedAt, CASE WHEN {_IN} THEN {_NOW} END AS UpdatedAt,"
            f" CASE WHEN NOT {_IN} THEN DeletedAt END AS DeletedAt FROM {HISTORY_SQL})"
        ),
    ),
    "purge_ids": (purge_ids, sql_state(f"{HISTORY_SQL} WHERE NOT {_IN}")),
    "purge_expired": (
        purge_expired,
        sql_state(
            f"{HISTORY_SQL} WHERE DeletedAt IS NULL OR DeletedAt >= {_NOW} - INTERVAL {V.RETENTION_DAYS} DAY"
        ),
    ),
    "missing_ids": (
        missing_ids,
        f"SELECT Id FROM {RETURNED_SQL} WHERE Id NOT IN (SELECT Id FROM {HISTORY_SQL} WHERE DeletedAt IS NULL)",
    ),
    "save_analysis": (save_analysis, SAVE_SQL),
    "append_history": (append_history, APPEND_SQL),
    "meta_merge": (update_meta, UPDATE_META_SQL),
    "rejected_patches": (rejected_patches, REJECTED_SQL),
    "update_signatures": (update_signatures, SIGNATURES_SQL),
    "saves_rejected": (saves_rejected, SAVES_REJECTED_SQL),
    "signatures_refused": (
        signatures_refused,
        f"SELECT Id, 'signatureADataUrl' AS error FROM {HISTORY_SQL} WHERE o_orderpriority = '3-MEDIUM'",
    ),
    "update_unmatched": (
        update_unmatched,
        "SELECT o_custkey * 2 AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders"
        " WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1",
    ),
    "update_by_key": (
        update_by_key,
        "SELECT c_custkey, c_name, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN"
        " (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    ),
    "backfill_text": (backfill_text, BACKFILL_SQL),
    "export_text": (export_text, EXPORT_SQL),
    "history_fold": (history_fold, FOLD_SQL),
    "history_fold_refused": (history_fold_refused, FOLD_REFUSED_SQL),
}
