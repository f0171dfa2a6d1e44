"""The reader of one huge JSON document, cut at every possible place."""

import json
import random

import pytest

from lexmill.sources import json_ranges, readers


def walked(text, cut, sizes):
    """Pieces of ``text`` dealt to ranges of the given numbers of pieces, each walked from its own start."""
    pieces = [p + cut for p in text.split(cut)]
    pieces[-1] = pieces[-1][: -len(cut)]
    out, at = [], 0
    in_string = depth = 0
    for size in [*sizes, len(pieces)]:
        run = "".join(pieces[at : at + size])
        if not run:
            break
        walk = json_ranges.Walk(bool(in_string), depth)
        for piece in pieces[at : at + size]:
            walk.feed(piece)
        out.append(walk.end())
        for i, part in enumerate(json_ranges.ESCAPE.sub("", run).split('"')):
            if (i + in_string) % 2 == 0:
                depth += json_ranges._depth(part)
        in_string = (in_string + json_ranges.ESCAPE.sub("", run).count('"')) % 2
        at += size
    return out


def put_together(ranges):
    found, open_piece, frame = [], "", ""
    for rows in ranges:
        for _, _, kind, text in rows:
            if kind == "whole":
                found.append(text)
            elif kind in ("tail", "middle"):
                open_piece += text
            elif kind == "head":
                found.append(open_piece + text)
                open_piece = ""
            elif kind == "frame":
                frame += text
            assert kind != "fault"
    return found, frame


NASTY = ["}", "{", "]", '"', "\\", '\\"}', "😀}", "é}\n", '{"a":[1,{"b":"}"}]}', ",", ":", " ", "plain"]


@pytest.mark.parametrize("cut", ["}", "]"])
def test_any_cut(cut):
    """Cuts inside strings, after escapes and surrogates, inside nested values, between elements."""
    rng = random.Random(7)
    for _ in range(300):
        docs = [
            rng.choice([None, 3, "x", rng.choice(NASTY), {"id": "".join(rng.choices(NASTY, k=3)), "n": [rng.choice(NASTY)]}, [1, [rng.choice(NASTY)]], {}, []])
            for _ in range(rng.randrange(6))
        ]
        whole = {"other": rng.choice([1, "}", [], {}]), "legaldocuments": docs, "z}": rng.choice(NASTY)}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        found, frame = put_together(walked(text, cut, [rng.randrange(1, 4) for _ in range(200)]))
        assert [json.loads(t) for t in found] == docs
        assert json.loads(frame).keys() == whole.keys()


def test_entries_of_an_object():
    rng = random.Random(8)
    for _ in range(100):
        vectors = {str(i) + rng.choice(["", "]", "}"]): [rng.random()] * rng.randrange(3) for i in range(rng.randrange(5))} | ({"s]": "x]y"} if rng.random() < 0.3 else {})
        found, _ = put_together(walked(json.dumps({"vectors": vectors}), "]", [rng.randrange(1, 3) for _ in range(50)]))
        merged = {}
        for text in found:
            merged |= json.loads("{" + text + "}")
        assert merged == vectors


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_one_file_over_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(2)
    docs = [{"id": str(i), "title": rng.choice(NASTY), "content": "".join(rng.choices(NASTY, k=rng.randrange(60)))} for i in range(80)]
    docs[40]["content"] = "}" * 5000  # an element over many ranges
    (tmp_path / "a.json").write_text(json.dumps({"legaldocuments": docs}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"x": [1], "legaldocuments": [docs[0]], "legaldocuments ": docs[:3]}) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"legaldocuments":[{"id":"1"} {"id":"2"}]}')
    (tmp_path / "d.json").write_text(json.dumps({"legaldocuments": docs})[:-300], encoding="utf-8")
    (tmp_path / "e.json").write_text('{"legaldocuments":{}}')
    (tmp_path / "f.json").write_text("")
    (tmp_path / "g.json").write_text(json.dumps({"legaldocuments": docs}) + "}", encoding="utf-8")
    parts = json_ranges.json_parts(spark, str(tmp_path / "a.json"))
    assert parts.select("block").distinct().count() > 10
    assert max(len(r.text) for r in parts.where("kind = 'whole'").collect()) < 3000
    rows = sorted(readers.read_legal_corpus(spark, str(tmp_path / "[ab].json")).collect())
    assert [(r.position, r.id, r.title, r.content) for r in rows] == [(i, d["id"], d["title"], d["content"]) for i, d in enumerate([*docs, docs[0]])]
    told = {r.path[-6:-5]: (r.is_valid, r.n_documents) for r in readers.corpus_validity(spark, str(tmp_path)).collect()}
    assert told == {"a": (True, 80), "b": (True, 1), "c": (False, None), "d": (False, None), "e": (True, None), "g": (False, None)}


def test_index_over_many_tasks(spark, tmp_path, small_splits):
    vectors = {str(i): [i + 0.5, -i, 1e-3] for i in range(200)}
    (tmp_path / "i.json").write_text(json.dumps({"vectors": vectors}))
    rows = readers.read_vector_index(spark, str(tmp_path / "i.json")).collect()
    assert {r.vec_id: r.embedding[0] for r in rows} == {i: i + 0.5 for i in range(200)}
