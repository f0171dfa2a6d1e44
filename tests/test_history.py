import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import history as H
from lexmill.operators.extraction import extract_contract_text
from lexmill.operators.fold import fold_history
from lexmill.streaming.history import current_records, streaming_history
from lexmill.streaming.retention import retention_sweep
from lexmill.streaming.sinks import write_epochs

NOW = datetime(2024, 3, 31, 12)
DAY = timedelta(days=1)
SCHEMA = (
    "Id bigint, UserId bigint, FileName string, RiskScore int, AnalysisJson string, ContractText string, "
    "AnalysisText string, CreatedAt timestamp, UpdatedAt timestamp, DeletedAt timestamp"
)


def record(id_, deleted=None, user=1, json_text='{"meta":{"title":"t"}}', text="x", name="f", created=None):
    return (id_, user, name, None, json_text, text, None, created or datetime(2024, 1, id_), None, deleted)


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        record(1),
        record(2, NOW - 30 * DAY),
        record(3, NOW - 30 * DAY - timedelta(microseconds=1)),
        record(4, NOW - DAY, user=2),
        record(5, user=2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "Id bigint")


def by_id(df):
    return {row.Id: row for row in df.collect()}


def test_lists(spark, table):
    assert [r.Id for r in H.list_history(table, 1).collect()] == [1]
    assert [r.Id for r in H.list_trash(table, 1).collect()] == [2, 3]
    assert [r.Id for r in H.list_history(table).collect()] == [1, 5]
    assert H.list_trash(table.drop("DeletedAt")).count() == 0
    assert H.list_history(table.drop("DeletedAt")).count() == 5
    assert sorted(r.Id for r in H.history_detail(table, ids(spark, 2, 5, 9)).collect()) == [2, 5]


def test_delete_restore_purge(spark, table):
    deleted = by_id(H.soft_delete(table, ids(spark, 1, 2, 2, 9), NOW))
    assert deleted[1].DeletedAt == deleted[1].UpdatedAt == NOW
    assert deleted[2].DeletedAt == NOW - 30 * DAY and deleted[2].UpdatedAt is None
    assert deleted[5].DeletedAt is None and len(deleted) == 5
    back = by_id(H.restore(table, ids(spark, 1, 2), NOW))
    assert back[2].DeletedAt is None and back[1].UpdatedAt == back[2].UpdatedAt == NOW
    assert sorted(by_id(H.purge(table, ids(spark, 1, 2)))) == [3, 4, 5]
    assert sorted(r.Id for r in H.missing_ids(table, ids(spark, 1, 2, 9), active_only=True).collect()) == [2, 9]
    assert [r.Id for r in H.missing_ids(table, ids(spark, 1, 2, 9)).collect()] == [9]


def test_retention_is_strict(table):
    assert sorted(by_id(H.purge_expired(table, NOW))) == [1, 2, 4, 5]


def test_update_meta(spark, table):
    patches = spark.createDataFrame(
        [
            (1, '{"title":"new","category":"c","secret":1}', 1),
            (1, '{"title":null}', 2),
            (2, "{}", 1),
            (3, '{"signaturePlacement":null}', 1),
            (4, '{"pagesImages":["data:image/png;base64,AA"],"pagesOriginalNames":["a"]}', 1),
            (5, '{"pagesImages":[]}', 1),
            (9, '{"title":"x"}', 1),
        ],
        "Id bigint, patch string, seq int",
    )
    updated, rejected = H.update_meta(table, patches, NOW)
    rows = by_id(updated)
    assert json.loads(rows[1].AnalysisJson)["meta"] == {"title": None, "category": "c"}
    assert rows[2].UpdatedAt == NOW and json.loads(rows[2].AnalysisJson)["meta"] == {"title": "t"}
    assert rows[3].UpdatedAt is None and rows[5].UpdatedAt is None
    assert json.loads(rows[4].AnalysisJson)["meta"]["pagesOriginalNames"] == ["a"]
    assert {(r.Id, r.error) for r in rejected.collect()} == {
        (3, "signaturePlacement"), (5, "pagesImages"), (9, "not found")
    }


def test_update_signatures(spark, table):
    patches = spark.createDataFrame(
        [
            (1, '{"signatureADataUrl":"data:image/png;base64,AA","signatureBDataUrl":null}', 1),
            (2, '{"signatureADataUrl":"data:application/pdf;base64,AA"}', 1),
            (4, '{"signatureBDataUrl":5}', 1),
        ],
        "Id bigint, patch string, seq int",
    )
    updated, rejected = H.update_signatures(table, patches, NOW)
    meta = json.loads(by_id(updated)[1].AnalysisJson)["meta"]
    assert meta["signatureBDataUrl"] is None and meta["signatureADataUrl"].endswith("AA") and meta["title"] == "t"
    assert {(r.Id, r.error) for r in rejected.collect()} == {(2, "signatureADataUrl"), (4, "signatureBDataUrl")}


def test_save_and_append(spark, table):
    schema = (
        "UserId bigint, FileName string, RiskScore int, content string, contractText string, derivedText string, "
        "meta string, RequestedAt timestamp"
    )
    requests = spark.createDataFrame(
        [
            (1, "a", None, '{"meta":{"k":1}}', "x\r\ny", None, '{"k":2}', NOW),
            (1, "b", 5, "bad", "  ", "derived", None, NOW - DAY),
            (1, "c", 5, None, "", None, None, NOW + DAY),
            (0, "d", 5, None, "", None, None, NOW),
            (2, "", 5, None, "", None, None, NOW),
        ],
        schema,
    )
    rows, rejected = H.save_analysis(requests)
    assert rejected.count() == 2
    whole, inserted = H.append_history(table, rows, ["CreatedAt"])
    assert sorted((r.Id, r.FileName) for r in inserted.collect()) == [(6, "b"), (7, "a"), (8, "c")]
    added = by_id(whole.where("Id > 5"))
    assert [added[i].ContractText for i in (6, 7, 8)] == ["derived", "x\ny", None]
    assert json.loads(added[7].AnalysisJson) == {"meta": {"k": 2}}
    assert json.loads(added[6].AnalysisJson) == {"meta": {}}
    assert added[7].DeletedAt is None and added[7].IsFinal == 1
    first, _ = H.append_history(table.limit(0), rows, ["CreatedAt"])
    assert sorted(by_id(first)) == [1, 2, 3]


def test_backfill(spark):
    url = "data:text/plain;base64,aMOgbmcgMQ0KaGFpDQo="
    packed = json.dumps({"meta": {"originalFileDataUrl": url, "originalFileName": "a.docx"}})
    df = spark.createDataFrame([record(1, json_text=packed, text=" "), record(2, text=None), record(3)], SCHEMA)
    files = H.original_files(df)
    assert [(r.Id, r.kind) for r in files.collect()] == [(1, "docx")]
    texts = extract_contract_text(files.withColumn("kind", F.lit("txt")), "Id", "stored")
    rows = by_id(H.backfill_contract_text(df, texts, NOW))
    assert rows[1].ContractText == "hàng 1\nhai" and rows[1].UpdatedAt == NOW
    assert rows[2].ContractText is None and rows[2].UpdatedAt is None and rows[3].ContractText == "x"


def test_backfilled_texts_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, None, None, None, NOW)], "Id bigint, AnalysisJson string, AnalysisText string, ContractText string, UpdatedAt timestamp_ntz")
    texts = spark.createDataFrame([(1, "t")], "Id bigint, text string")
    plan = H.backfill_contract_text(df, texts, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan



def test_export(spark):
    meta = json.dumps({"meta": {"title": "", "category": "c", "description": "d"}})
    df = spark.createDataFrame(
        [record(1, json_text=meta, text="a \n b ", created=datetime(2025, 3, 4, 15, 30)), record(2, json_text=None, text="", name="")],
        SCHEMA,
    )
    lines = {r.Id: r.lines for r in H.export_contract_text(df).collect()}
    assert lines[1] == "f\nNgày tạo: 15:30:00 4/3/2025\nDanh mục: c\nMô tả: d\nNội dung hợp đồng\na\nb "
    assert lines[2].startswith("Hồ sơ #2\n") and lines[2].endswith("(Chưa có nội dung hợp đồng được lưu)")


# --- the fold ---------------------------------------------------------------------


def simulate(log, as_of, days):
    """Commands applied one by one to a dict, with the sweep before each of them."""
    table = {}
    born = set()

    def sweep(now):
        for key in [k for k, r in table.items() if r["deleted"] and r["deleted"] < now - timedelta(days=days)]:
            del table[key]

    for key, ts, _, cmd, body in sorted(log, key=lambda c: (c[1], c[2])):
        sweep(ts)
        row = table.get(key)
        if cmd == "save" and key not in born:
            born.add(key)
            table[key] = {"created": ts, "updated": None, "deleted": None, "json": {"meta": {}, **json.loads(body)}}
        elif row is None:
            continue
        elif cmd == "delete" and not row["deleted"]:
            row["deleted"] = row["updated"] = ts
        elif cmd == "restore":
            row.update(deleted=None, updated=ts)
        elif cmd == "patch":
            row["json"]["meta"].update(json.loads(body))
            row["updated"] = ts
        elif cmd == "purge":
            del table[key]
    sweep(as_of)
    return {k: (r["created"], r["updated"], r["deleted"], json.dumps(r["json"], sort_keys=True)) for k, r in table.items()}


def state(df):
    return {
        r.Id: (r.CreatedAt, r.UpdatedAt, r.DeletedAt, json.dumps(json.loads(r.AnalysisJson), sort_keys=True))
        for r in df.collect()
    }


def random_log(seed, records=25, size=900):
    rng = random.Random(seed)
    log = []
    for seq in range(size):
        # A third of all commands fall on record 0; whole seconds make ties.
        key = 0 if rng.random() < 0.33 else rng.randrange(records)
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(70 * 24) * 3600)
        cmd = rng.choices(["save", "delete", "restore", "patch", "purge", "read"], [3, 5, 4, 6, 0.15, 1])[0]
        body = json.dumps({rng.choice("abc"): rng.choice([1, "x", None, [2]])})
        log.append((key, ts, seq, cmd, body))
    return log


LOG = "Id bigint, ts timestamp, seq bigint, cmd string, body string"


@pytest.mark.parametrize("seed, days, slices", [(1, 30, None), (2, 30, 6), (3, 5, 6), (4, 2, 11), (5, 1, 3)])
def test_fold_equals_simulation(spark, seed, days, slices):
    log, as_of = random_log(seed), datetime(2024, 3, 15)
    df = spark.createDataFrame(log, LOG).repartition(4)
    records, refused = fold_history(df, as_of, days, keys=tuple("abc"), slices=slices)
    assert state(records) == simulate(log, as_of, days) and refused.isEmpty()


@pytest.mark.parametrize("slices", [1, 7])
def test_fold_of_one_record_at_one_time(spark, slices):
    rng = random.Random(3)
    cmds = ["save", *rng.choices(["delete", "restore", "patch"], k=400)]
    log = [(1, NOW, seq, cmd, json.dumps({rng.choice("abc"): seq})) for seq, cmd in enumerate(cmds)]
    records, _ = fold_history(spark.createDataFrame(log, LOG), NOW + DAY, keys=tuple("abc"), slices=slices)
    assert state(records) == simulate(log, NOW + DAY, 30)


def test_fold_refuses_what_a_change_refuses(spark):
    bodies = ['{"signaturePlacement":"bad","evil":1}', '{"pagesImages":[]}', "broken", '{"title":"t","evil":1}', None]
    log = [(1, NOW, 0, "save", '{"s":1}')] + [(1, NOW + DAY, i, "patch", b) for i, b in enumerate(bodies, 1)]
    records, refused = fold_history(spark.createDataFrame(log, LOG), NOW + DAY)
    assert {r.seq: r.error for r in refused.collect()} == {1: "signaturePlacement", 2: "pagesImages", 3: H.UNREADABLE}
    assert json.loads(records.first().AnalysisJson) == {"s": 1, "meta": {"title": "t"}}


SIGNED = [
    '{"signatureADataUrl":"data:image/png;base64,AA=="}',
    '{"signatureBDataUrl":"data:text/plain;base64,AA=="}',
    '{"signatureADataUrl":7,"title":"lost"}',
    '{"signatureBDataUrl":null,"title":"t"}',
]
SIGNED_LOG = [(1, NOW, 0, "save", '{"s":1}')] + [(1, NOW + n * DAY, n, "patch", b) for n, b in enumerate(SIGNED, 1)]
SIGNED_META = {"signatureADataUrl": "data:image/png;base64,AA==", "signatureBDataUrl": None, "title": "t"}


def test_fold_keeps_and_refuses_signatures(spark):
    records, refused = fold_history(spark.createDataFrame(SIGNED_LOG, LOG), NOW + 5 * DAY)
    assert {r.seq: r.error for r in refused.collect()} == {2: "signatureBDataUrl", 3: "signatureADataUrl"}
    row = records.first()
    assert json.loads(row.AnalysisJson) == {"s": 1, "meta": SIGNED_META} and row.UpdatedAt == NOW + 4 * DAY


def test_fold_of_a_refused_signature_changes_nothing(spark):
    row = fold_history(spark.createDataFrame([SIGNED_LOG[0], SIGNED_LOG[2]], LOG), NOW + 5 * DAY)[0].first()
    assert json.loads(row.AnalysisJson) == {"s": 1, "meta": {}} and row.UpdatedAt is None


def test_stream_keeps_and_refuses_signatures(spark, tmp_path):
    # The last command waits for a watermark that never comes.
    log = [*SIGNED_LOG, (2, NOW + 9 * DAY, 9, "save", "{}")]
    spark.createDataFrame(log, LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    versions = streaming_history(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), "1 day")
    write_epochs(versions, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination()
    row = current_records(spark.read.parquet(str(tmp_path / "out")).drop("epoch"), NOW + 9 * DAY).first()
    assert row.Id == 1 and json.loads(row.AnalysisJson) == {"s": 1, "meta": SIGNED_META}
    assert row.UpdatedAt == NOW + 4 * DAY


def test_fold_limits_keys(spark):
    log = [(1, NOW, 1, "save", "{}"), (1, NOW + DAY, 2, "patch", '{"title":"a","x":1}')]
    row = fold_history(spark.createDataFrame(log, LOG), NOW + DAY)[0].first()
    assert json.loads(row.AnalysisJson) == {"meta": {"title": "a"}}


@pytest.mark.parametrize("days", [30, 3])
def test_stream_equals_fold(spark, tmp_path, days):
    log = random_log(9, size=400)
    as_of = datetime(2024, 3, 15)
    log.append((99, datetime(2024, 3, 14), 10_000, "save", "{}"))
    # Three files, each reaching back two days into the one before.
    log.sort(key=lambda c: c[1] - (2 * DAY if c[2] % 3 == 0 else 0 * DAY))
    source = str(tmp_path / "in")
    for n in range(3):
        part = log[n * len(log) // 3 : (n + 1) * len(log) // 3]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    versions = streaming_history(arriving, "3 days", days, keys=tuple("abc"))
    write_epochs(versions, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination()
    seen = current_records(spark.read.parquet(str(tmp_path / "out")).drop("epoch"), as_of, days)
    # Commands newer than the last watermark still wait.
    due = [c for c in log if c[1] <= datetime(2024, 3, 14) - 3 * DAY]
    assert state(seen) == simulate(due, as_of, days)


def test_sweep(spark, tmp_path, table):
    source, swept = str(tmp_path / "ticks"), {}
    spark.createDataFrame([(NOW,)], "ts timestamp").write.parquet(source)
    clock = spark.readStream.schema("ts timestamp").parquet(source)

    def store(df, epoch):
        swept[epoch] = sorted(r.Id for r in df.collect())

    retention_sweep(clock, lambda: table, store, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
    assert swept == {0: [1, 2, 4, 5]}


def test_rejected_patches_are_judged_once(spark, table):
    rows = [(1, '{"title":"t"}', 1), (9, '{"title":"t"}', 1), (9, "{", 2), (None, '{"title":"t"}', 3), (None, "{", 4), (1, "{", 5)]
    patches = spark.createDataFrame(rows, "Id bigint, patch string, seq int")
    _, rejected = H.update_meta(table.unionByName(table), patches, NOW)
    assert rejected.columns == ["Id", "patch", "seq", "error"]
    assert sorted((r.seq, r.Id, r.error) for r in rejected.where("seq > 1").collect()) == [
        (2, 9, H.UNREADABLE), (3, None, "not found"), (4, None, H.UNREADABLE), (5, 1, H.UNREADABLE)
    ]
    assert [(r.Id, r.error) for r in rejected.where("seq = 1").collect()] == [(9, "not found")]
    assert rejected._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1


def test_placements_are_read_by_their_known_parts(spark, table):
    """Writing a whole placement as JSON text, each of its own keys included, was dear (F9)."""
    place = {"pageIndex": 0, **{k: {"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.1, "note": "n"} for k in "ab"}, "by": {"x": "0.1"}}
    text = {**place, "a": {**place["a"], "x": "0.1"}}
    rows = [
        (1, json.dumps({"signaturePlacement": place, "other": 1}), 1),
        (1, '{"title":"late","title":"last"}', 3),
        (1, '{"title":"early","description":null}', 2),
        (2, json.dumps({"signaturePlacement": text}), 1),
        (2, json.dumps({"signaturePlacement": {**place, "pageIndex": True}}), 2),
        (2, json.dumps({"signaturePlacement": [text]}), 3),
        (2, '{"signaturePlacement":5}', 4),
        (2, '{"signaturePlacement":null}', 5),
        (4, "[1]", 1),
        (5, "null", 1),
    ]
    patches = spark.createDataFrame(rows, "Id bigint, patch string, seq int")
    updated, rejected = H.update_meta(table, patches, NOW)
    found = by_id(updated)
    assert json.loads(found[1].AnalysisJson) == {
        "meta": {"title": "last", "description": None, "signaturePlacement": place}
    }
    assert found[2].UpdatedAt is None and found[4].UpdatedAt == found[5].UpdatedAt == NOW
    assert sorted((r.seq, r.error) for r in rejected.collect()) == [(n, "signaturePlacement") for n in range(1, 6)]
    plan = updated._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(pageIndex,VariantType,true)" in plan
