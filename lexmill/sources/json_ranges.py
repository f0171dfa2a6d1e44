"""One huge JSON document read by many tasks.

Spark's text source cuts a file into byte ranges at a character that closes
elements, ``}`` or ``]``, wherever it stands, in strings too. What a range means
depends on how the text before it ends: inside a string or not, and how deep.

1. Every range is summed up as a map from either start to its end: whether the
   quotes flip it, and how much the depth changes. An escape cannot reach over a
   cut. 2. The maps are composed along the file, one short row per range. 3. With
   its start known, every range emits the elements it holds; an element that
   reaches over cuts comes in pieces that are put together by key.

A document is an object whose values may be lists or objects; elements are what
those hold, as JSON text. Broadcast is one row per range, so per 128 MB of file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.json_meta import safe_json_parse
from lexmill.session import shared_dir

SUMMARY = "file string, block bigint, size bigint, bytes bigint, flips boolean, outside bigint, inside bigint"
PARTS = "file string, block bigint, list bigint, place bigint, kind string, text string"
KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
ESCAPE = re.compile(r"\\.", re.DOTALL)
TOKEN = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def _pieces(spark: SparkSession, path: str, cut: str) -> DataFrame:
    rows = spark.read.option("lineSep", cut).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _ranges(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, str]]:
    """Pieces one by one, each with the named values of its range."""
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in names]
        yield from zip(zip(*columns, strict=True), batch.column("value").to_pylist(), strict=True)


def range_starts(pieces: DataFrame, cut: str) -> DataFrame:
    """``(file, block, in_string, depth, last, open_end)``: how each range begins, and whether the file's last piece has no cut behind it."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, [0, 0, 0, 0]
        for key, piece in _ranges(batches, ["file", "block", "size"]):
            if key != now:
                if now:
                    yield _summary(now, state)
                now, state = key, [0, 0, 0, 0]
            text = piece + cut
            state[0] += len(text.encode())
            parts = (ESCAPE.sub("", text) if "\\" in text else text).split('"')
            for part in parts[:-1]:
                state[2 + state[1]] += _depth(part)
                state[1] ^= 1
            state[2 + state[1]] += _depth(parts[-1])
        if now:
            yield _summary(now, state)

    ranges = pieces.mapInArrow(sum_up, SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    flipped = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    ranges = ranges.withColumns(
        {
            "in_string": flipped,
            "last": F.col("block") == F.max("block").over(whole),
            "open_end": F.sum("bytes").over(whole) > F.col("size"),
        }
    )
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum(change).over(before), F.lit(0))
    return ranges.select("file", "block", "in_string", depth.alias("depth"), "last", "open_end")


def _summary(key: tuple, state: list[int]) -> pa.RecordBatch:
    size, flips, outside, inside = state
    values = [*key, size, bool(flips), outside, inside]
    return pa.RecordBatch.from_pylist([dict(zip([p.split()[0] for p in SUMMARY.split(", ")], values, strict=True))])


class Walk:
    """One range, from a known start. Depth 0 and 1 is the frame, 2 a list (or object) of elements, 3 and more inside one."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth
        self.rows: list[tuple] = []  # (list, place, kind, text)
        self.list, self.place = 0, 0
        self.frame: list[str] = []
        self.gap: list[str] = []
        self.after_element = depth >= 2
        self.element: list[str] | None = [] if depth > 2 or (depth == 2 and in_string) else None
        self.kind = "head" if self.element is not None else "whole"

    def feed(self, text: str) -> None:
        at = 0
        for token in TOKEN.finditer(text):
            mark = token.group()
            if len(mark) == 2:
                continue
            if mark == '"':
                self.in_string = not self.in_string
                if not self.in_string and self.depth == 2 and self.element is not None:
                    rest = text[token.end() :].lstrip()
                    if not rest.startswith(":"):  # a string of the list itself, cut inside
                        self._say(text[at : token.end()])
                        self._close()
                        at = token.end()
                continue
            if self.in_string:
                continue
            self._say(text[at : token.start()])
            at = token.end()
            if mark in "{[":
                self._open(mark)
            else:
                self._shut(mark)
        self._say(text[at:])

    def _say(self, text: str) -> None:
        (self.element if self.element is not None else self.gap if self.depth >= 2 else self.frame).append(text)

    def _open(self, mark: str) -> None:
        if self.depth == 1:
            key = KEY.search("".join(self.frame))
            self.frame.append(mark)
            self.list += 1
            self.place, self.after_element = 0, False
            self.rows.append((self.list, 0, "list" if mark == "[" else "map", json.loads(f'"{key.group(1)}"') if key and _text_of(key.group(1)) else None))
        elif self.depth == 2 and self.element is None:
            gap = "".join(self.gap)
            key = KEY.search(gap)
            self._end_gap(gap[: key.start()] if key else gap, True)
            self.element = [key.group() if key else "", mark]
        else:
            self._say(mark)
        self.depth += 1

    def _shut(self, mark: str) -> None:
        self.depth -= 1
        if self.depth >= 2:
            self._say(mark)
            if self.depth == 2 and self.element is not None:
                self._close()
        elif self.depth == 1:
            if self.element is not None:
                self._close()
            self._end_gap("".join(self.gap), False)
            self.frame.append(mark)
        else:
            self.frame.append(mark)

    def _close(self) -> None:
        if self.kind == "head":
            self.rows.append((self.list, 0, "head", "".join(self.element)))
        else:
            self.rows.append((self.list, self.place, "whole", "".join(self.element)))
            self.place += 1
        self.element, self.kind, self.after_element = None, "whole", True

    def _end_gap(self, gap: str, before_element: bool) -> None:
        """What stands between elements: separators, and plain values, which are elements too."""
        self.gap = []
        if gap.strip() == "," and self.after_element and before_element or not gap.strip() and not (self.after_element and before_element):
            return
        ends = "0" if self.after_element else "", "0" if before_element else ""
        try:
            values = _values("[" + ends[0] + gap + ends[1] + "]")
            values = values[len(ends[0]) : len(values) - len(ends[1])]
        except ValueError:
            try:
                named = '"":0' if ends[0] else "", '"":0' if ends[1] else ""
                pairs = json.loads("{" + named[0] + gap + named[1] + "}", object_pairs_hook=list, parse_constant=_refuse)
                pairs = pairs[len(ends[0]) : len(pairs) - len(ends[1])]
                values = [json.dumps(k) + ":" + json.dumps(v) for k, v in pairs]
            except ValueError:
                self.rows.append((self.list, 0, "fault", gap[:100]))
                return
        for value in values:
            self.rows.append((self.list, self.place, "whole", value))
            self.place += 1

    def end(self) -> list[tuple]:
        if self.depth == 2 and self.element is None and (self.in_string or "".join(self.gap).strip()):
            gap = "".join(self.gap)
            start = gap.rfind(",") if not self.in_string else _before_string(gap)
            self._end_gap(gap[:start], True) if self.in_string else self._end_gap(gap, False)
            if self.in_string:
                self.element = [gap[start:]]
        if self.element is not None:
            kind = "middle" if self.kind == "head" else "tail"
            self.rows.append((self.list, self.place, kind, "".join(self.element)))
        if self.frame:
            self.rows.append((0, 0, "frame", "".join(self.frame)))
        return self.rows


def _before_string(gap: str) -> int:
    """Where the string that is still open begins, or the name before it."""
    parts = ESCAPE.sub("__", gap).split('"')
    start = len(gap) - len(parts[-1]) - 1
    name = KEY.search(gap[:start])
    return name.start() if name else start


def _refuse(name: str):
    raise ValueError(name)


def _values(text: str) -> list[str]:
    return [json.dumps(v, ensure_ascii=False) for v in json.loads(text, parse_constant=_refuse)]


def _text_of(body: str) -> bool:
    try:
        json.loads(f'"{body}"')
    except ValueError:
        return False
    return True


def json_parts(spark: SparkSession, path: str, cut: str = "}") -> DataFrame:
    """``PARTS`` of the files at ``path``: kind ``list`` and ``map`` (a key and where its value begins), ``whole`` (an element),
    ``tail``, ``middle`` and ``head`` (pieces of one), ``frame`` (text around the lists) and ``fault`` (no separator).

    ``list`` counts the lists that begin in a range, 0 is one that began before it;
    ``place`` counts the elements that begin in this range's part of a list. The
    parts are checkpointed, since they are read more than once.
    """
    pieces = _pieces(spark, path, cut)
    starts = F.broadcast(range_starts(pieces, cut))
    known = pieces.join(starts, ["file", "block"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held = None, None, None
        for key, piece in _ranges(batches, ["file", "block", "in_string", "depth", "last", "open_end"]):
            if key != now:
                if now:
                    state.feed(held if now[4] and now[5] else held + cut)
                    yield _part_rows(now, state.end())
                now, state, held = key, Walk(key[2], key[3]), None
            if held is not None:
                state.feed(held + cut)
                if len(state.rows) > 1000:
                    yield _part_rows(now, state.rows)
                    state.rows = []
            held = piece
        if now:
            state.feed(held if now[4] and now[5] else held + cut)
            yield _part_rows(now, state.end())

    shared_dir(spark)
    return known.mapInArrow(walk, PARTS).checkpoint(eager=True)


def _part_rows(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    lists, places, kinds, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [
        pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(lists, pa.int64()),
        pa.array(places, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string()),
    ]
    return pa.record_batch(columns, names=["file", "block", "list", "place", "kind", "text"])


def elements(parts: DataFrame, key: str) -> DataFrame:
    """``(file, position, text)`` of the elements under ``key``, counted from 0 within each file.

    If the key is repeated, its last list counts.
    """
    # Lists and counts are a few rows per range.
    along = Window.partitionBy("file").orderBy("block", "list")
    begun = parts.where("kind in ('list', 'map')").select("file", "block", "list", F.col("text").alias("key"))
    counts = parts.where(F.col("kind").isin("whole", "tail")).groupBy("file", "block", "list").agg(F.count("*").alias("n"))
    runs = counts.join(begun, ["file", "block", "list"], "full")
    number = F.sum(F.when(F.col("list") > 0, 1).otherwise(0)).over(along)
    named = F.last(F.when(F.col("list") > 0, F.struct("key")), ignorenulls=True).over(along)["key"]
    runs = runs.withColumn("number", number).withColumn("key", named).where(F.col("key") == key)
    runs = runs.withColumn("most", F.max("number").over(Window.partitionBy("file"))).where("number = most")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "block", "list", "start")
    placed = parts.where(F.col("kind").isin("whole", "tail")).join(F.broadcast(runs), ["file", "block", "list"])
    placed = placed.select("file", "block", (F.col("start") + F.col("place")).alias("position"), "kind", "text")
    whole = placed.where("kind = 'whole'").select("file", "position", "text")
    ends = placed.where("kind = 'tail'").select("file", F.col("block").alias("tail"), "position")
    return whole.unionByName(ends.join(_joined(parts), ["file", "tail"]).select("file", "position", "text"))


def _joined(parts: DataFrame) -> DataFrame:
    """``(file, tail, text)`` of elements that reach over cuts, named by the range they begin in.

    A range has at most a head and a tail, or one middle. Which belong together is
    found without their texts.
    """
    pieces = parts.where(F.col("kind").isin("tail", "middle", "head")).select("file", "block", "kind", "text")
    order = F.when(F.col("kind") == "tail", 1).otherwise(0)
    along = Window.partitionBy("file").orderBy("block", order)
    tail = F.last(F.when(F.col("kind") == "tail", F.col("block")), ignorenulls=True).over(along)
    owner = pieces.select("file", "block", "kind").withColumn("tail", tail)
    texts = F.sort_array(F.collect_list(F.struct("block", order.alias("o"), "text")))
    joined = pieces.join(owner, ["file", "block", "kind"]).groupBy("file", "tail")
    return joined.agg(F.array_join(F.transform(texts, lambda p: p["text"]), "").alias("text"))


def validity(parts: DataFrame, key: str) -> DataFrame:
    """``(file, is_valid, n_elements)``: whether a file is one JSON value, and how many elements the list ``key`` has, null
    if it has no such list. An empty file has no range and so no row.

    The frame, with its lists left empty, is parsed as one text; elements are parsed
    one by one, pieces of one together; separators were looked at by their range.
    """
    frame = parts.where("kind = 'frame'").groupBy("file").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("frame")
    )
    named = F.concat(F.lit("{"), "text", F.lit("}"))
    good = safe_json_parse(F.col("text")).isNotNull() | safe_json_parse(named).isNotNull()
    whole = parts.where("kind = 'whole'").select("file", good.alias("good"))
    cut = _joined(parts).select("file", good.alias("good"))
    faults = parts.where("kind = 'fault'").select("file", F.lit(False).alias("good"))
    judged = whole.unionByName(cut).unionByName(faults).groupBy("file").agg(F.min("good").alias("good"))
    counted = elements(parts, key).groupBy("file").agg(F.count("*").alias("n"))
    has = parts.where((F.col("kind") == "list") & (F.col("text") == key)).select("file", F.lit(True).alias("has")).distinct()
    valid = safe_json_parse(F.col("frame")).isNotNull() & F.coalesce("good", F.lit(True))
    joined = frame.join(judged, "file", "left").join(counted, "file", "left").join(has, "file", "left").withColumn("is_valid", valid)
    return joined.select("file", "is_valid", F.when(F.col("is_valid") & F.col("has"), F.coalesce("n", F.lit(0))).alias("n_elements"))
