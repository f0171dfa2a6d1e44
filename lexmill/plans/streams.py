"""Streams over the test tables; each must give what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.plans.common import AS_OF_EVENTS, DIM, HISTORY_SQL, PATCH_SQL, command_log, history, sql_stamp, stamp, table
from lexmill.plans.history import FOLD_SQL, folded, sql_state, state
from lexmill.plans.text import CHUNK_PAGES_SQL
from lexmill.sources.readers import stream_history_commands
from lexmill.streaming.history import DAY_MICROS, current_records, streaming_history
from lexmill.streaming.ingest import current_index, stream_ingest
from lexmill.streaming.retention import retention_sweep
from lexmill.streaming.rate_limit import rate_limit_violations
from lexmill.streaming.sinks import fresh_folder, write_epochs

# About two events per user and day: a limit the test data exceeds.
LIMIT = 3
WIDTH = "1 day"


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream of its file, or of the files in its folder.

    A pattern names both; a plain path of a stream must be a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def requests(events: DataFrame) -> DataFrame:
    """Events as requests; user 0 is nobody and goes by an address."""
    return events.select("ts", "user_id", F.concat(F.lit("ip-"), "event_type").alias("ip"))


def _shown(violations: DataFrame) -> DataFrame:
    return violations.select("key", stamp("window_start").alias("window_start"), "n")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rate_limit_violations(requests(table(spark, sf_dir, "events")), LIMIT, WIDTH))


def _streamed_rate(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    found = rate_limit_violations(requests(arriving(spark, sf_dir, "events")), LIMIT, WIDTH, **how)
    path = fresh_folder(spark, "rate-limit")
    write_epochs(found, path, f"{path}-checkpoint", mode="update").awaitTermination()
    newest = spark.read.parquet(path).groupBy("key", "window_start").agg(F.max("n").alias("n"))
    return _shown(newest)


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_rate(spark, sf_dir, delay="0 seconds")


RATE_SQL = f"""
    WITH RECURSIVE asked AS (
      SELECT CASE WHEN user_id <> 0 THEN user_id::VARCHAR ELSE 'ip-' || event_type END AS key, ts::TIMESTAMP AS ts FROM events),
    opened(key, s) AS (
      SELECT key, min(ts) FROM asked GROUP BY key
      UNION ALL
      SELECT o.key, min(a.ts) FROM opened o JOIN asked a ON a.key = o.key AND a.ts >= o.s + INTERVAL '{WIDTH}' GROUP BY o.key)
    SELECT o.key, {sql_stamp('s')} AS window_start, count(*) AS n
    FROM opened o JOIN asked a ON a.key = o.key AND a.ts >= s AND a.ts < s + INTERVAL '{WIDTH}'
    GROUP BY o.key, s HAVING count(*) > {LIMIT}"""


def rate_limit_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with windows aligned to the clock."""
    return _shown(rate_limit_violations(requests(table(spark, sf_dir, "events")), LIMIT, WIDTH, aligned=True))


def rate_limit_clock_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_rate(spark, sf_dir, aligned=True)


RATE_CLOCK_SQL = f"""
    SELECT key, {sql_stamp('day')} AS window_start, count(*) AS n
    FROM (SELECT CASE WHEN user_id <> 0 THEN user_id::VARCHAR ELSE 'ip-' || event_type END AS key,
      date_trunc('day', ts)::TIMESTAMP AS day FROM events)
    GROUP BY 1, day HAVING count(*) > {LIMIT}"""


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = command_log(arriving(spark, sf_dir, "events"))
    versions = streaming_history(log, delay="0 seconds", slot_micros=7 * DAY_MICROS)  # a record has a few commands a week
    path = fresh_folder(spark, "history")
    write_epochs(versions, path, f"{path}-checkpoint", mode="update").awaitTermination()
    return folded(current_records(spark.read.parquet(path).drop("epoch"), AS_OF_EVENTS))


def commands_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands written as files of JSON lines, and read back as they arrive."""
    files, seen = fresh_folder(spark, "commands"), fresh_folder(spark, "arrived")
    log = command_log(table(spark, sf_dir, "events"))
    log.withColumn("ts", F.col("ts").cast("timestamp")).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(files)
    write_epochs(stream_history_commands(spark, files), seen, f"{seen}-checkpoint").awaitTermination()
    return spark.read.parquet(seen).select("Id", stamp("ts").alias("ts"), "seq", "cmd", "body")


COMMAND_FILES_SQL = f"""
    SELECT Id, {sql_stamp("ts")} AS ts, seq, cmd,
      CASE WHEN cmd <> 'patch' THEN props ELSE {PATCH_SQL} END AS body
    FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'save' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'restore'
        WHEN 'click' THEN 'patch' ELSE CASE WHEN event_type = 'view' AND k < 2 THEN 'purge' ELSE 'read' END END AS cmd
      FROM (SELECT user_id AS Id, ts::TIMESTAMP AS ts, event_id AS seq, event_type, props, (props->>'$.k')::INTEGER AS k FROM events))"""


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = arriving(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        F.col("page_id").alias("position"),
        F.lit("").alias("title"),
        F.lit(None).cast("string").alias("document_type"),
        F.col("url").alias("source_url"),
        F.col("html").alias("content"),
    )
    path = fresh_folder(spark, "index")
    stream_ingest(pages, path, f"{path}-checkpoint", dim=DIM).awaitTermination()
    return current_index(spark, path).select(
        "id", "metadata.title", "metadata.document_type", "metadata.source_url", "metadata.text"
    )


def retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history swept as of the last order that has arrived."""
    clock = arriving(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"))
    path = fresh_folder(spark, "swept")

    def store(swept: DataFrame, epoch: int) -> None:
        swept.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    retention_sweep(clock, lambda: history(spark, sf_dir), store, f"{path}-checkpoint", trigger={"availableNow": True}).awaitTermination()
    swept = spark.read.parquet(path)
    return state(swept.join(swept.agg(F.max("epoch").alias("epoch")), "epoch"))


RETENTION_SQL = sql_state(
    f"{HISTORY_SQL} WHERE DeletedAt IS NULL"
    f" OR DeletedAt >= (SELECT max(o_orderdate)::TIMESTAMP FROM orders) - INTERVAL {V.RETENTION_DAYS} DAY"
)


QUERIES = {
    "retention_stream": (retention_stream, RETENTION_SQL),
    "rate_limit": (rate_limit, RATE_SQL),
    "rate_limit_stream": (rate_limit_stream, RATE_SQL),
    "rate_limit_clock": (rate_limit_clock, RATE_CLOCK_SQL),
    "rate_limit_clock_stream": (rate_limit_clock_stream, RATE_CLOCK_SQL),
    "history_stream": (history_stream, FOLD_SQL),
    "commands_from_files": (commands_from_files, COMMAND_FILES_SQL),
    "ingest_stream": (ingest_stream, CHUNK_PAGES_SQL),
}
