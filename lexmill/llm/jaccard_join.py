"""N-gram Jaccard join: documents whose five-word shingle sets overlap by 0.8 or more, and what they connect.

1. Each text is read once: its set's size and digest, 64 MinHash values, 32 keys
   of two values each. Equal sets are one class, so copies are never paired.
2. Classes that share a key may belong together. Keys of one class are dropped
   by a count. Under a key of usual size, classes are tied whose MinHash values
   agree often enough. Classes under a very frequent key are dealt once more, to
   that key with each of their others, and tied so there. Only under a frequent
   pair of keys, four equal values, all are tied to its first class, row by
   row, which can only make more classes meet. Two sets that link share fewer
   than two of the 32 keys with a chance below 4e-13 (none: 1e-14) and fall
   short of ``AGREE`` values with one below 1e-13; all are of the order at
   which hashed shingles are told apart at all.
3. Tied classes form clusters. A cluster's texts meet in one task, or, by the
   number of their shingles, in blocks of which every two meet. There a
   signature tree finds the links and verifies them exactly.
4. Components of the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import words
from lexmill.llm.common import kept, unused
from lexmill.llm.components import components
from lexmill.llm.signature_tree import Tree

VALUES, PER_KEY = 64, 2
AGREE = 24
USUAL_KEY = 2048
BLOCK_SHINGLES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(7))
_SALTS = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SETS = "doc_id {kind}, text_key binary, n_shingles bigint, set_key binary, marks binary, keys array<bigint>"


def min_values(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``(documents, 64)`` MinHash values; documents without shingles get the greatest value."""
    has = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, VALUES), 2**64 - 1, dtype=np.uint64)
    if len(has):
        for k in range(VALUES):
            out[has, k] = np.minimum.reduceat((value ^ _SALTS[k]) * _FACTORS[k], bounds[has])
    return out


def shingle_table(docs: DataFrame) -> DataFrame:
    """One row per document: set size, digest, one byte of each MinHash value (``marks``) and the keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                value, bounds = words.shingle_sets(words.find_words(part.column("text"), lower=True))
                least = min_values(value, bounds)
                marks = words.mix(least).astype(np.uint8)
                keys = np.zeros((len(least), VALUES // PER_KEY), dtype=np.uint64)
                for k in range(PER_KEY):
                    keys = words.mix(keys + least[:, k::PER_KEY] + np.arange(VALUES // PER_KEY, dtype=np.uint64))
                edges = np.arange(len(least) + 1) * (VALUES // PER_KEY)
                digests = [hashlib.md5(value[a:b].tobytes()).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(np.diff(bounds)),
                        pa.array(digests, pa.binary()),
                        pa.array([row.tobytes() for row in marks], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "marks", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    return rows.mapInArrow(read, SETS.format(kind=kind))


def _ties(rows: DataFrame) -> DataFrame:
    """``(a, b)`` of classes under one key whose marks agree; ``rows(key, class, marks)`` come grouped by key."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for k, c, m in zip(*(batch.column(n).to_pylist() for n in ("key", "class", "marks")), strict=True):
                if k != key:
                    edges += _agreeing(held)
                    key, held = k, []
                held.append((c, m))
            yield _edge_batch(edges)
        yield _edge_batch(_agreeing(held))

    return rows.mapInArrow(tie, "a bigint, b bigint")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _agreeing(held: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """A spanning forest of the classes whose marks agree: each is reached from one found before."""
    if len(held) < 2:
        return []
    classes = [c for c, _ in held]
    marks = np.frombuffer(b"".join(m for _, m in held), dtype=np.uint8).reshape(len(held), VALUES)
    left = np.arange(len(held))
    edges = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = (marks[left] == marks[at]).sum(axis=1) >= AGREE
            found = left[near].tolist()
            edges += [(classes[i], classes[at]) for i in found]
            front += found
            left = left[~near]
    return edges


def _possible_ties(classes: DataFrame) -> DataFrame:
    shared = kept(_shared_keys(classes.select("class", F.explode("keys").alias("key"))))
    ties = _usual_ties(shared, classes)
    frequent = shared.where(F.col("_n") > USUAL_KEY).select("class", "key")
    if frequent.isEmpty():
        return ties.distinct()
    refined = kept(_shared_keys(_key_pairs(classes, frequent)))
    hot = refined.where(F.col("_n") > USUAL_KEY).select(F.col("class").alias("a"), F.col("_hub").alias("b"))
    return ties.unionByName(_usual_ties(refined, classes)).unionByName(hot).distinct()


def _shared_keys(rows: DataFrame) -> DataFrame:
    """``rows(class, key)`` under keys of more than one class, with the number of the key's rows and its first class.

    Most keys are of one class, so rows move once and without their marks.
    """
    of_key = Window.partitionBy("key")
    counted = rows.select("class", "key", F.count("*").over(of_key).alias("_n"), F.min("class").over(of_key).alias("_hub"))
    return counted.where("_n > 1")


def _usual_ties(shared: DataFrame, classes: DataFrame) -> DataFrame:
    usual = shared.where(F.col("_n") <= USUAL_KEY).select("class", "key").join(classes.select("class", "marks"), "class")
    return _ties(usual.select("key", "class", "marks").repartition("key").sortWithinPartitions("key", "class"))


def _key_pairs(classes: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(class, key)``: for ``frequent`` rows, one key for each pair of theirs and another key of the class."""
    held = classes.select("class", "keys").join(frequent.select("class", F.col("key").alias("_one")), "class")
    others = F.filter("keys", lambda key: key != F.col("_one"))
    pairs = F.transform(others, lambda key: F.xxhash64(F.least(key, F.col("_one")), F.greatest(key, F.col("_one"))))
    return held.select("class", F.explode(pairs).alias("key")).distinct()


def _links(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b)``: a spanning forest of the exact links within each cluster's blocks."""
    sized = members.join(classes.select("class", "n_shingles", "doc_id", "text_key"), members["node"] == classes["class"])
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("_blocks"))
    placed = sized.join(blocks, "component").withColumn("_own", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    placed = placed.select("component", "class", "doc_id", "text_key", "_own", others)
    placed = placed.select(
        "component", "class", "doc_id", "text_key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    )
    texts = docs.select(
        F.col("doc_id").alias("_doc"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_key"), F.col("text")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    met = texts.join(placed, same).select("component", "_i", "_j", "class", "text")
    met = met.repartition("component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "class")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            for part in words.slices(batch, "text"):
                edges: list[tuple[int, int]] = []
                value, bounds = words.shingle_sets(words.find_words(part.column("text"), lower=True))
                keys = zip(*(part.column(n).to_pylist() for n in ("component", "_i", "_j")), strict=True)
                for at, (key, own) in enumerate(zip(keys, part.column("class").to_pylist(), strict=True)):
                    if key != group:
                        edges += _tree_edges(held)
                        group, held = key, {}
                    held[own] = value[bounds[at] : bounds[at + 1]].copy()  # repeated rows are one class
                yield _edge_batch(edges)
        yield _edge_batch(_tree_edges(held))

    return met.mapInArrow(link, "a bigint, b bigint")


def _tree_edges(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    if len(held) < 2:
        return []
    classes, sets = list(held), list(held.values())
    order = [(int(((s ^ _SALTS[0]) * _FACTORS[0]).min()) if len(s) else 0, len(s)) for s in sets]
    first = Tree(sets, order).connect()
    return [(classes[i], classes[k]) for i, k in enumerate(first.tolist()) if i != k]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document.

    ``docs`` has ``doc_id, text``; other columns are not read. ``component_id``
    is the least ``doc_id`` reachable by links of 0.8 or more, itself included.
    A text of fewer than five words is one shingle; null and empty texts have
    no shingles, link with nothing and are components of their own. Repeated
    rows are members of one class. A null ``doc_id`` can be reached but is never
    a component's name, unless all of the component's ids are null.
    """
    return _labelled(docs).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame) -> DataFrame:
    """The same with ``text_key``, the text's md5, and ``component``, a number of its own for each component."""
    table = kept(shingle_table(docs))
    filled = table.where("n_shingles > 0")
    classes = filled.groupBy("set_key").agg(
        F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_first"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("marks").alias("marks"),
        F.first("keys").alias("keys"),
    )
    classes = classes.select("set_key", "_first.*", "n_shingles", "marks", "keys")
    classes = kept(classes.withColumn("class", F.monotonically_increasing_id()))
    clusters = kept(components(kept(_possible_ties(classes))))
    joined = components(kept(_links(docs, clusters, classes)))
    named = classes.select("set_key", "class", "doc_id").join(joined, F.col("class") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("set_key", "component").join(names, "component")
    columns = ["doc_id", "text_key", "n_shingles", "component_id", "component"]
    alone = table.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("bigint"))
    return filled.join(by_set, "set_key").select(*columns).unionByName(alone.select(*columns))


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, its least id; all columns stay.

    Texts without words stay. Of rows that repeat id and text, one stays; of a
    component whose ids are all null, the one of the least text digest.
    """
    found = kept(_labelled(docs))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.where("component is not null").groupBy("component").agg(F.min(row).alias("_row"))
    doc, key, one, at = unused(docs, "_doc", "_key", "_one", "_place")
    keys = first.select(F.col("_row.doc_id").alias(doc), F.col("_row.text_key").alias(key), F.lit(True).alias(one))
    empty = found.where("component is null").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.lit(False).alias(one))
    keys = keys.unionByName(empty.distinct())
    text_key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    joined = docs.join(keys, F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key == F.col(key)))
    place = F.row_number().over(Window.partitionBy(doc, key).orderBy(F.lit(0)))
    return joined.withColumn(at, place).where(~F.col(one) | (F.col(at) == 1)).select(*docs.columns)
