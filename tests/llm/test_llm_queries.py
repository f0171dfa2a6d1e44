"""Registered queries of the subpackage against their SQL, and the pipeline stage by stage against plain versions."""

import glob
import math
import os
import subprocess
import sys
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from plain import brute_components, brute_removal, grams, tokens

from lexmill.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 9) if isinstance(value, float) else value


def ordered(rows):
    return sorted((tuple(map(plain, row)) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    rows = ordered(df.select(*columns).collect())
    assert rows
    if sql:
        database = duckdb.connect()
        for path in glob.glob(f"{SF_DIR}/*.parquet"):
            database.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
        selected = ", ".join(f'"{column}"' for column in columns)
        assert rows == ordered(database.execute(f"SELECT {selected} FROM ({sql})").fetchall())


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    seen = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF_DIR).write.parquet(str(tmp_path / str(number)))
        seen.append(spark.read.parquet(str(tmp_path / str(number))))
    raw, accepted, single, cut, clean, mix = ([r.asDict() for r in df.collect()] for df in seen)
    assert all(df.columns == docs.columns for df in seen[:5])

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in raw} - {r["doc_id"] for r in accepted}
    assert gone and all(labels.get(i, 0) == 0 for i in gone)

    tops = brute_components([grams(r["text"]) for r in accepted])
    groups = defaultdict(list)
    for top, r in zip(tops, accepted, strict=True):
        groups[top].append(r["doc_id"])
    assert {r["doc_id"] for r in single} == {min(ids) for ids in groups.values()}

    expected = {r["doc_id"]: (kept if m else r["text"]) for r, (_, m, kept) in zip(single, brute_removal([r["text"] for r in single]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in cut} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    def contaminated(text):
        have = grams(text)
        return any(5 * len(grams(item) & have) >= 4 * len(grams(item)) for item in items)

    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in cut if not contaminated(r["text"])}

    sizes = {r["doc_id"]: len(tokens(r["text"])) for r in clean}
    taken, whole = Counter(), {r["doc_id"]: r for r in clean}
    for r in mix:
        assert 0 < r["taken"] <= 2 * sizes[r["doc_id"]] and r["size"] == sizes[r["doc_id"]]
        assert whole[r["doc_id"]] == {name: r[name] for name in docs.columns}
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 2 for r in mix)


def test_pipeline_runs(spark):
    mix = corpus_pipeline.run(spark, SF_DIR)
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert mix.columns == [*columns, "size", "source_size", "target", "taken"]
    assert mix.count() > 0 and mix.where("text is null or taken = 0").count() == 0


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline, the entry still imports and has the other queries."""
    script = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.split('.')[:2] == ['lexmill', 'llm']:\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as entry\n"
        "assert 'pipeline' not in entry.queries() and 'op1_chat_format' not in entry.queries()\n"
        "assert 'knn_topk' in entry.queries()\n"
    )
    subprocess.run([sys.executable, "-c", script], cwd=ROOT, check=True, timeout=120)
