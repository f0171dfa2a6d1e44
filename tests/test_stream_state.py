"""State of the streaming history: restarts from the checkpoint, and the cost of commands that wait."""

import json
from datetime import datetime

from test_history import DAY, LOG, random_log, simulate, state

from lexmill.plans.streams import ingest_stream
from lexmill.streaming.history import HOUR_MICROS, RecordKeeper, current_records, streaming_history


def test_restarted_between_out_of_order_files(spark, tmp_path):
    """Every file is a run of its own that goes on from the checkpoint; commands reach back two days."""
    log = random_log(21, size=240)
    as_of = datetime(2024, 3, 15)
    log.append((99, datetime(2024, 3, 14), 10_000, "save", "{}"))
    log.sort(key=lambda c: c[1] - (2 * DAY if c[2] % 3 == 0 else 0 * DAY))
    out = str(tmp_path / "out")
    for n in range(3):
        part = log[n * len(log) // 3 : (n + 1) * len(log) // 3]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        versions = streaming_history(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), "3 days", 30, keys=tuple("abc"))

        def store(batch, epoch):
            batch.write.mode("append").parquet(out)

        versions.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    due = [c for c in log if c[1] <= datetime(2024, 3, 14) - 3 * DAY]
    assert state(current_records(spark.read.parquet(out), as_of, 30)) == simulate(due, as_of, 30)


class Row:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Slots(dict):
    read = written = 0

    def getValue(self, key):
        self.read += len(self[key][0])
        return self[key]

    def updateValue(self, key, value):
        self.written += len(value[0])
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.row, self.slots, self.timers = Row(), Slots(), set()

    def getValueState(self, name, schema):
        return self.row

    def getMapState(self, name, key, value):
        return self.slots

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, micros):
        self.micros = micros

    def getCurrentWatermarkInMs(self):
        return self.micros // 1000


def asked(commands):
    import pandas as pd

    return iter([pd.DataFrame(commands, columns=["micros", "seq", "cmd", "body"])])


def fire(keeper, handle, clock):
    due = {t for t in handle.timers if t <= clock.getCurrentWatermarkInMs()}
    handle.timers -= due  # Spark removes a timer that has fired
    return [row for _ in due for frame in keeper.handleExpiredTimer((1,), clock, None) for row in frame.to_dict("records")]


def test_waiting_commands_cost_what_is_due():
    keeper, handle = RecordKeeper(30, HOUR_MICROS), Handle()
    keeper.init(handle)
    commands = [(HOUR_MICROS * (i // 20) + i * 1000, i, "patch", json.dumps({"title": str(i)})) for i in range(20_000)]
    commands[0] = (0, 0, "save", "{}")
    list(keeper.handleInputRows((1,), asked(commands[::-1]), Clock(0)))
    assert len(handle.slots) == 1000 and len(handle.timers) == 1
    handle.slots.read = handle.slots.written = 0
    rows = fire(keeper, handle, Clock(HOUR_MICROS * 2 + 45_000))
    assert [json.loads(r["AnalysisJson"])["meta"]["title"] for r in rows] == ["45"]
    assert handle.slots.read <= 80 and handle.slots.written <= 20 and len(handle.timers) == 1
    assert fire(keeper, handle, Clock(HOUR_MICROS * 2 + 46_000)) and handle.slots.read <= 140
    # An earlier command moves the timer; a purge leaves neither slots nor timer.
    list(keeper.handleInputRows((1,), asked([(HOUR_MICROS * 2 + 47_000, 5, "purge", None)]), Clock(HOUR_MICROS * 2 + 46_000)))
    assert len(handle.timers) == 1
    assert [r["gone"] for r in fire(keeper, handle, Clock(HOUR_MICROS * 3))] == [True]
    assert not handle.slots and not handle.timers
    list(keeper.handleInputRows((1,), asked([(HOUR_MICROS * 9, 1, "save", "{}")]), Clock(HOUR_MICROS * 4)))
    assert not handle.slots and not handle.timers


def test_a_table_arrives_as_a_file_or_as_a_folder_of_files(spark, tmp_path):
    html = "<p>" + "word " * 60 + "</p>"
    rows = spark.createDataFrame([(i, f"u{i}", html) for i in range(6)], "page_id bigint, url string, html string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "file" / "pages.parquet")
    for form in ("folder", "file"):
        found = ingest_stream(spark, str(tmp_path / form))
        assert sorted(r.id for r in found.collect()) == [f"doc_{i}_chunk_0" for i in range(6)]
