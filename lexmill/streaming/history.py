"""The history table kept up to date by a stream of commands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexmill import fixed_values as V
from lexmill.functions.json_meta import object_map, safe_json_parse
from lexmill.operators.fold import judge_commands
from lexmill.operators.history import PATCH_KEYS, patch_error
from lexmill.operators.joins import last_per_key

DAY_MICROS = 24 * 60 * 60 * 1_000_000
HOUR_MICROS = 60 * 60 * 1_000_000
OUTPUT = (
    "Id bigint, CreatedAt timestamp, UpdatedAt timestamp, DeletedAt timestamp, gone boolean, "
    "AnalysisJson string, version bigint"
)
RECORD = (
    "born bigint, body string, gone boolean, deleted bigint, updated bigint, meta string, version bigint, "
    "slots array<bigint>, timer bigint"
)
COMMANDS = "ats array<bigint>, seqs array<bigint>, cmds array<string>, bodies array<string>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_record() -> dict:
    return {"born": None, "body": None, "gone": False, "deleted": None, "updated": None, "meta": {}, "version": 0}


def _object(text: str | None) -> dict:
    try:
        value = json.loads(text or "")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def apply_command(record: dict, at: int, cmd: str, body: str | None, days: int) -> None:
    """One command on a record, at a time in microseconds."""
    if record["gone"]:
        return
    if record["born"] is None:
        if cmd == "save":
            record.update(born=at, body=body)
        return
    if record["deleted"] is not None and at - record["deleted"] > days * DAY_MICROS:
        record["gone"] = True
    elif cmd == "purge":
        record["gone"] = True
    elif cmd == "delete" and record["deleted"] is None:
        record.update(deleted=at, updated=at)
    elif cmd == "restore":
        record.update(deleted=None, updated=at)
    elif cmd == "patch":
        record["meta"].update(_object(body))
        record["updated"] = at


def _row(key: int, record: dict) -> pd.DataFrame:
    stored = _object(record["body"])
    meta = stored.get("meta") if isinstance(stored.get("meta"), dict) else {}
    merged = json.dumps({**stored, "meta": {**meta, **record["meta"]}}, ensure_ascii=False)
    times = {name: pd.to_datetime(record[field], unit="us") if record[field] is not None else pd.NaT
             for name, field in (("CreatedAt", "born"), ("UpdatedAt", "updated"), ("DeletedAt", "deleted"))}
    return pd.DataFrame(
        [{"Id": key, **times, "gone": record["gone"], "AnalysisJson": merged, "version": record["version"]}]
    )


class RecordKeeper(StatefulProcessor):
    """State of one record: its row, and the commands that wait, in slots of event time.

    A slot is one entry of a map; the row knows which slots are filled. One timer
    per record stands for its earliest command. When it fires, only slots that have
    begun are read, and only what is due is applied. A record that is gone keeps
    that fact alone: no slot, no timer.
    """

    def __init__(self, days: int, slot: int):
        self.days, self.slot = days, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("record", RECORD)
        self.waiting = handle.getMapState("waiting", "slot bigint", COMMANDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        record, slots, timer = self._held()
        if record["gone"]:
            return
        arrived: dict[int, list[tuple]] = {}
        for batch in rows:
            for at, seq, cmd, body in zip(batch["micros"], batch["seq"], batch["cmd"], batch["body"], strict=True):
                arrived.setdefault(int(at) // self.slot, []).append((int(at), int(seq), cmd, body))
        if not arrived:
            return
        for slot, commands in arrived.items():
            if slot in slots:
                commands = self._commands(slot) + commands
            self._store(slot, commands)
        earliest = min(at for commands in arrived.values() for at, *_ in commands)
        timer = self._wake(timer, earliest, timerValues)
        self._keep(record, sorted({*slots, *arrived}), timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        record, slots, timer = self._held()
        if record["gone"]:
            return
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        applied, left = False, []
        for place, slot in enumerate(slots):
            if slot * self.slot > mark:
                left = slots[place:]
                break
            commands = sorted(self._commands(slot), key=lambda item: item[:2])
            due = [item for item in commands if item[0] <= mark]
            for at, _, cmd, body in due:
                apply_command(record, at, cmd, body, self.days)
            applied = applied or bool(due)
            if len(due) < len(commands):
                self._store(slot, commands[len(due) :])
                left = slots[place:]
                break
            self.waiting.removeKey((slot,))
        record["version"] += int(applied)
        told = applied and record["born"] is not None
        if record["gone"]:
            self.waiting.clear()
            self._keep({**new_record(), "gone": True, "born": record["born"], "version": record["version"]}, [], None)
        else:
            first = min((item[0] for item in self._commands(left[0])), default=None) if left and left[0] * self.slot <= mark else None
            timer = self._wake(None, first if first is not None else left[0] * self.slot, timerValues) if left else None
            self._keep(record, left, timer)
        if told:
            yield _row(key[0], record)

    def _held(self) -> tuple[dict, list[int], int | None]:
        if not self.row.exists():
            return new_record(), [], None
        born, body, gone, deleted, updated, meta, version, slots, timer = self.row.get()
        record = {"born": born, "body": body, "gone": gone, "deleted": deleted, "updated": updated, "meta": json.loads(meta), "version": version}
        return record, list(slots), timer

    def _keep(self, record: dict, slots: list[int], timer: int | None) -> None:
        times = record["born"], record["body"], record["gone"], record["deleted"], record["updated"]
        self.row.update((*times, json.dumps(record["meta"]), record["version"], slots, timer))

    def _commands(self, slot: int) -> list[tuple]:
        return list(zip(*self.waiting.getValue((slot,)), strict=True))

    def _store(self, slot: int, commands: list[tuple]) -> None:
        self.waiting.updateValue((slot,), tuple(list(column) for column in zip(*commands, strict=True)))

    def _wake(self, timer: int | None, at: int, timerValues) -> int:
        """Makes the record's timer fire once the watermark has passed ``at``, if it doesn't fire before."""
        wanted = max(-(-at // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        if timer is not None and timer <= wanted:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(wanted)
        return wanted


def streaming_history(
    commands: DataFrame,
    delay: str = "10 minutes",
    days: int = V.RETENTION_DAYS,
    keys: tuple[str, ...] = PATCH_KEYS,
    error_of=patch_error,
    slot_micros: int = HOUR_MICROS,
) -> DataFrame:
    """Versions of records as commands take effect: the newest per Id is the table.

    Commands may arrive out of order within ``delay``: they wait until the
    watermark has passed them and are then applied in event-time order. They wait
    in slots of ``slot_micros``, so a record with very many of them costs what is
    due. Refused patches have no effect. Rows later than the watermark are dropped
    and counted by Spark, see ``late_commands``. Sets the session's state store to
    RocksDB, which keeps timers.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = commands.where(F.col("cmd").isin("save", "delete", "restore", "patch", "purge"))
    # The JSON rules are those of the batch form: what reaches the state has been read and written by Spark.
    read = F.when(F.col("cmd") == "patch", F.to_json("_body")).when(
        F.col("cmd") == "save", F.to_json(object_map(safe_json_parse(F.col("body"))))
    )
    log = (
        judge_commands(known, keys, error_of)
        .where(F.col("error").isNull())
        .withColumn("body", read)
        .withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
        # A watermark counts whole milliseconds: the next one passes every command of this one.
        .withColumn("ts", F.timestamp_micros(F.col("micros") + 1000))
        .withWatermark("ts", delay)
        .select("Id", "ts", "micros", "seq", "cmd", "body")
    )
    keeper = RecordKeeper(days, slot_micros)
    return log.groupBy("Id").transformWithStateInPandas(keeper, OUTPUT, "Update", "EventTime")


def late_commands(query: StreamingQuery) -> int:
    """Commands of a running or ended query that came after the watermark had passed them."""
    return sum(int(op.numRowsDroppedByWatermark) for progress in query.recentProgress for op in progress.stateOperators)


def current_records(versions: DataFrame, as_of, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Surviving records from the versions a stream has written."""
    newest = last_per_key(versions, "Id", ["version"]).where(~F.col("gone"))
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    kept = newest.where(F.col("DeletedAt").isNull() | (F.col("DeletedAt") >= cutoff))
    return kept.select("Id", "CreatedAt", "UpdatedAt", "DeletedAt", "AnalysisJson")
