"""Substring dedup: removes word sequences that stand at more than one place, with an FM-index per shard.

A window is ``WINDOW`` words. Its anchor is the least hash of the eight-word
grams in it, so equal windows have equal anchors, wherever they stand. A run of
windows with one anchor is a segment; every window lies in exactly one segment.

1. One pass cuts all texts into segments: anchor, content digest, place.
2. Anchors that stand at one place only are dropped by a count; most go here.
3. Equal segments are one row with a weight, and only that row carries text.
   Rows are dealt to shards by anchor, so all places of a window meet in one
   index. An anchor of very many different segments would be too much for one
   shard: its segments are cut into single windows, which are again made one
   row per content and dealt by that.
4. In each shard the segments are streamed through the shard's FM-index;
   intervals of ``WINDOW`` words or more that stand at least twice come back.
5. They are joined to all places of their segments, and each text is rewritten once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import words
from lexmill.llm.common import kept, unused
from lexmill.llm.fm_index import FMIndex

WINDOW = 35
GRAM = 8
MOST_WINDOWS = 512  # of one segment
SHARD_WORDS = 1 << 20
HOT_SEGMENTS = 1 << 14  # different segments of one anchor

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def _span_digest(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the words from ``first`` to before ``end``."""
    n = len(hashes)
    power, back = np.full(n + 1, _STEP), np.full(n + 1, _BACK)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:-1], out=total[1:])
    return words.mix((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64))


def segments(found: words.Words) -> tuple[np.ndarray, ...]:
    """``(text, first word, windows, anchor, places of the anchor, digest)`` of all segments of the texts."""
    hashes = words.word_hashes(found)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    grams = words.gram_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    least, span = grams, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])[:n]
    owner = found.rows()
    inside = owner[:n] == owner[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    value, row = least[at], owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    begins = np.flatnonzero(new)
    lengths = np.diff(np.r_[begins, len(at)])
    if lengths.max() > MOST_WINDOWS:  # a long run is cut; its windows stay one to a segment
        pieces = -(-lengths // MOST_WINDOWS)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(begins, pieces) + part * MOST_WINDOWS
        lengths = np.minimum(np.repeat(lengths, pieces) - part * MOST_WINDOWS, MOST_WINDOWS)
    first, anchor, text = at[begins], value[begins], row[begins]
    places = _places_of(anchor, first, first + lengths + width - 1, grams)
    return text, first - found.bounds[text], lengths, anchor.view(np.int64), places, _span_digest(hashes, first, first + lengths + WINDOW - 1).view(np.int64)


def _places_of(anchor: np.ndarray, first: np.ndarray, end: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How many grams of each range equal the range's anchor."""
    known = np.unique(anchor)
    rank = np.searchsorted(known, grams)
    rank[rank == len(known)] = 0
    at = np.flatnonzero(known[rank] == grams)
    line = np.sort(rank[at] * (len(grams) + 1) + at)  # by gram, then by place
    base = np.searchsorted(known, anchor) * (len(grams) + 1)
    return np.searchsorted(line, base + end) - np.searchsorted(line, base + first)


def _places(docs: DataFrame) -> DataFrame:
    """``(doc, text_hash, first, windows, anchor, places, digest)`` of all segments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                text, first, length, anchor, places, digest = segments(words.find_words(part.column("text")))
                yield pa.record_batch(
                    [
                        part.column("doc").take(pa.array(text)),
                        part.column("text_hash").take(pa.array(text)),
                        *(pa.array(x.astype(np.int32)) for x in (first, length)),
                        pa.array(anchor),
                        pa.array(np.minimum(places, 2).astype(np.int32)),
                        pa.array(digest),
                    ],
                    names=["doc", "text_hash", "first", "windows", "anchor", "places", "digest"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc {kind}, text_hash bigint, first int, windows int, anchor bigint, places int, digest bigint")


def _segment_texts(docs: DataFrame, wanted: DataFrame, hot: bool) -> DataFrame:
    """The texts of ``wanted(doc, text_hash, anchor, digest, first, windows, weight)``; of ``hot`` ones, of each window.

    A document that is there twice tells its texts twice.
    """
    item = F.struct("anchor", "digest", "first", "windows", "weight")
    grouped = wanted.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(item).alias("items"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    joined = docs.join(grouped, same).select("items", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = words.find_words(part.column("text"))
                hashes = words.word_hashes(found) if hot else None
                data = found.data.tobytes()
                out: list[tuple] = []
                for row, items in enumerate(part.column("items").to_pylist()):
                    base = found.bounds[row]
                    for one in items:
                        begins = [(one["first"], one["windows"])]
                        if hot:
                            begins = [(one["first"] + k, 1) for k in range(one["windows"])]
                        for first, n in begins:
                            a, b = base + first, base + first + n + WINDOW - 1
                            key = int(_span_digest(hashes[a:b], np.array([0]), np.array([b - a])).view(np.int64)[0]) if hot else 0
                            text = data[found.starts[a] : found.ends[b - 1]].decode()
                            out.append((one["anchor"], one["digest"], one["weight"], first - one["first"], key, text))
                columns = list(zip(*out, strict=True)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "digest", "weight", "shift", "window", "text"])

    return joined.mapInArrow(cut, "anchor bigint, digest bigint, weight bigint, shift int, window bigint, text string")


SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _search(units: DataFrame, shards: int) -> DataFrame:
    """``(anchor, digest, spans)`` of the segments ``units(anchor, digest, weight, text)`` with anything that repeats."""
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            at = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                if held and at[first] != shard:
                    yield _intervals(held)
                    held = []
                shard = at[first]
                held.append(_hashed(batch.slice(first, last - first)))
        if held:
            yield _intervals(held)

    kind = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("spans", SPAN)])
    return dealt.select("shard", "anchor", "digest", "weight", "text").mapInArrow(search, kind)


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    parts = []
    for part in words.slices(batch, "text"):
        found = words.find_words(part.column("text"))
        digest = part.column("digest")
        own = (part.column("anchor").to_numpy(), digest.fill_null(0).to_numpy(), digest.is_null().to_numpy(zero_copy_only=False), part.column("weight").to_numpy())
        parts.append((words.word_hashes(found), found.counts, *own))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _intervals(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    hashes, counts, anchor, digest, single, weight = (np.concatenate(x) for x in zip(*held, strict=True))
    first = np.unique(np.stack([anchor, digest, single], axis=1), axis=0, return_index=True)[1]
    if len(first) < len(anchor):  # told twice
        own = np.zeros(len(anchor), dtype=bool)
        own[first] = True
        hashes, counts, anchor, digest, single, weight = hashes[np.repeat(own, counts)], *(x[own] for x in (counts, anchor, digest, single, weight))
    index = FMIndex(hashes, np.r_[0, np.cumsum(counts)].astype(np.int64), weight)
    seq, first, end = index.repeated(WINDOW)
    order = np.argsort(seq, kind="stable")
    seq, first, end = seq[order], first[order], end[order]
    rows = np.unique(seq)
    offsets = np.r_[np.searchsorted(seq, rows), len(seq)]
    spans = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["first", "end"])
    return pa.record_batch(
        [pa.array(anchor[rows]), pa.array(digest[rows], mask=single[rows]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
        names=["anchor", "digest", "spans"],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text")


def repeated_spans(docs: DataFrame, shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``(doc, text_hash, spans)``: word ranges covered by windows that stand elsewhere too, per id and text."""
    rows = _keyed(docs)
    places = _places(rows)
    several = places.groupBy("anchor").agg(F.sum("places").alias("_n")).where("_n > 1").select("anchor")
    places = kept(places.join(several, "anchor", "left_semi"))
    head = F.min_by(F.struct("doc", "text_hash", "first", "windows"), F.struct(F.col("doc").isNull(), "doc", "text_hash", "first")).alias("_at")
    distinct = kept(places.groupBy("anchor", "digest").agg(F.count("*").alias("weight"), head).select("anchor", "digest", "weight", "_at.*"))
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_segments).select("anchor")
    crowded = kept(crowded)
    units = _segment_texts(rows, distinct.join(crowded, "anchor", "left_anti"), hot=False).select("anchor", "digest", "weight", "text")
    pieces = None
    if crowded.head(1):
        pieces = _segment_texts(rows, distinct.join(crowded, "anchor", "left_semi"), hot=True)
        pieces = kept(pieces.dropDuplicates(["anchor", "digest", "shift"]))
    if pieces is not None:
        windows = pieces.groupBy("window").agg(F.sum("weight").alias("weight"), F.first("text").alias("text"))
        one = F.lit(None).cast("bigint").alias("digest")  # marks a row that is one window
        units = units.unionByName(windows.select(F.col("window").alias("anchor"), one, "weight", "text"))
    total = distinct.agg(F.coalesce(F.sum(F.col("windows") + WINDOW - 1), F.lit(0)).alias("n")).first()["n"]
    if pieces is not None:
        total += WINDOW * pieces.select("window").distinct().count()
    found = _search(units, max(1, math.ceil(total / shard_words)))
    if pieces is not None:
        found = kept(found)
        single = found.where("digest is null").select(F.col("anchor").alias("window"))
        span = F.struct(F.col("shift").alias("first"), (F.col("shift") + WINDOW).alias("end"))
        again = pieces.join(single, "window", "left_semi").groupBy("anchor", "digest").agg(F.collect_list(span).alias("spans"))
        found = found.where("digest is not null").unionByName(again)
    own = places.join(found, ["anchor", "digest"])
    moved = F.transform("spans", lambda s: F.struct((s["first"] + F.col("first")).alias("first"), (s["end"] + F.col("first")).alias("end")))
    return own.groupBy("doc", "text_hash").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _with_spans(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` with a column of the spans to remove, and that column's name."""
    doc, key, name = unused(docs, "_doc", "_hash", "_spans")
    spans = repeated_spans(docs.select("doc_id", "text"), **options)
    spans = spans.select(F.col("doc").alias(doc), F.col("text_hash").alias(key), F.col("spans").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(spans, same, "left").drop(doc, key), name


def _covered(found: words.Words, spans: pa.Array) -> np.ndarray:
    """Which words of the texts lie in a span."""
    depth = np.zeros(len(found.starts) + 1, dtype=np.int64)
    lists = spans.fill_null([]) if spans.null_count else spans
    flat = lists.flatten()
    if len(flat):
        n = np.asarray(lists.value_lengths())
        base = np.repeat(found.bounds[:-1], n)
        np.add.at(depth, base + np.asarray(flat.field("first")), 1)
        np.add.at(depth, base + np.asarray(flat.field("end")), -1)
    return np.cumsum(depth)[:-1] > 0


def _kept_texts(found: words.Words, gone: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    data, out = found.data.tobytes(), []
    starts, ends = found.starts.tolist(), found.ends.tolist()
    for first, end in zip(found.bounds.tolist(), found.bounds[1:].tolist(), strict=False):
        stays = (np.flatnonzero(~gone[first:end]) + first).tolist()
        out.append(b" ".join([data[starts[k] : ends[k]] for k in stays]))
    return out


def removal_digests(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document.

    A word goes if a window of 35 consecutive words that covers it stands at
    another place too, of the same document or of any other; windows are judged
    on the input. Words are compared as they are. Null and empty texts have no
    words. Repeated rows are places of their own, so each takes the other's
    words away; texts of fewer than 35 words lose nothing.
    """
    rows, spans = _with_spans(docs.select("doc_id", "text"), **options)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = words.find_words(part.column("text"))
                gone = _covered(found, part.column(spans))
                total = np.r_[0, np.cumsum(gone)]
                hashes = [hashlib.sha256(text).hexdigest() for text in _kept_texts(found, gone)]
                removed = total[found.bounds[1:]] - total[found.bounds[:-1]]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(found.counts), pa.array(removed), pa.array(hashes)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; all columns stay.

    A text that loses nothing stays as it is, blanks included. One that loses
    words becomes its kept words joined by one space, so one that loses all is empty.
    """
    rows, spans = _with_spans(docs, **options)
    place = docs.columns.index("text")
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.record_batch(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for part in words.slices(batch, str(place)):
                texts, spans = part.column(place), part.column(part.num_columns - 1)
                found = words.find_words(texts)
                gone = _covered(found, spans)
                told = [
                    new.decode() if marked is not None else old
                    for new, marked, old in zip(_kept_texts(found, gone), spans.to_pylist(), texts.to_pylist(), strict=True)
                ]
                columns = list(part.columns[:-1])
                columns[place] = pa.array(told, pa.string())
                yield pa.record_batch(columns, names=schema.names)

    return rows.select(*docs.columns, spans).mapInArrow(rewrite, schema)
