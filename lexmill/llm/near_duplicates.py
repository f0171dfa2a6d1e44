"""Near duplicates by one-permutation hashing: documents whose four-word shingle sets overlap by 0.8 or more.

1. Each text is read once. Its shingle hashes fall into 64 bins and each bin keeps
   its least; an empty bin borrows from another one, chosen by a hash of the bin
   and of the attempt (optimal densification). Two bins make a band: 32 keys.
   Equal sets are one class, so copies are never paired. Sets below ``FEWEST``
   shingles link only with sets of one shingle more or less; they meet by the
   hash of the set and of the set without each shingle, which is exact.
2. Star-shaped candidates: in each bucket every class is paired with the bucket's
   hub alone, the class that shares the most buckets, which tends to be the text
   that the others were made from. First each class with its best hub, then with
   other hubs that it isn't connected to yet. Candidates are verified on full sets.
3. What stars can miss: classes of one bucket that are still apart. Their sizes and
   signatures (``AGREE`` bins) say which may link, and a spanning forest of these
   pairs, not the pairs, ties them into clusters. Classes of a hot bucket must share
   a second one, and what is still large meets by pairs of blocks. A cluster's sets
   come together in blocks of bounded size, where every pair of different labels is
   looked at by a finer signature and verified on full sets if that agrees.
4. Components of the links.

Simulated at a similarity of exactly 0.8 for 8 to 1200 shingles, agreeing bins have
mean 51.2 and deviation 3.9 or less (of 256 bins 204.8 and 8.1), shared bands mean
20.5 and at least 7 in 100,000 pairs: ``AGREE`` and ``FINE_AGREE`` are 6 deviations
away, and sharing less than two of 32 independent bands has a chance of 4e-13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import words
from lexmill.llm.common import kept
from lexmill.llm.components import components

SHINGLE_WORDS = 4
BINS, PER_BAND = 64, 2
BANDS = BINS // PER_BAND
LINK = (4, 5)  # intersection : union
LEAST_SHARED = 2
AGREE = 28
FINE_BINS, FINE_AGREE = 256, 155
FEWEST = 8
BUCKET = 4096
HUB_MEMBERS = 512
BLOCK_SHINGLES = 1 << 19
BROADCAST_ROWS = 500_000

NONE = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

SKETCH = (
    "doc_id {kind}, text_key binary, n_shingles bigint, set_key binary, marks binary, "
    "keys array<bigint>, whole bigint, less array<bigint>"
)


# --- signatures ----------------------------------------------------------------------


def signatures(value: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``(documents, bins)``: the least shingle hash of each bin, empty bins filled; all ``NONE`` without shingles."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    at = (value >> _shift(bins)).astype(np.int64)
    first = np.ones(len(value), dtype=bool)  # hashes of a text are sorted, so a bin's first is its least
    first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    least = np.full((rows, bins), NONE, dtype=np.uint64)
    least[row[first], at[first]] = value[first]
    return densified(least)


def _shift(bins: int) -> np.uint64:
    """What leaves the bin's number of a hash."""
    return np.uint64(64 - bins.bit_length() + 1)


def densified(least: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled one in their own sequence of bins, the same for all sets."""
    filled = least != NONE
    out = least.copy()
    row, at = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = np.uint64(0)
    while len(row):
        attempt += np.uint64(1)
        pick = (words.mix(at.astype(np.uint64) * _STEP + attempt) >> _shift(least.shape[1])).astype(np.int64)
        good = filled[row, pick]
        out[row[good], at[good]] = least[row[good], pick[good]]
        row, at = row[~good], at[~good]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for k in range(PER_BAND):
        keys = words.mix(keys + signature[:, k::PER_BAND] + np.arange(BANDS, dtype=np.uint64))
    return keys


def _small_keys(own: np.ndarray) -> tuple[int | None, list[int] | None]:
    """The key of a small set, and of the sets that lack one of its shingles."""
    if not 0 < len(own) <= FEWEST:
        return None, None
    parts = words.mix(own)
    total = parts.sum(dtype=np.uint64)
    less = words.mix(total - parts).view(np.int64).tolist() if len(own) > LINK[0] else None
    return (int(words.mix(np.array([total])).view(np.int64)[0]) if LINK[0] <= len(own) < FEWEST else None), less


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document (``SKETCH``): set size and digest, one byte of each bin (``marks``), and what it is found by."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                value, bounds = words.shingle_sets(words.find_words(part.column("text"), lower=True), SHINGLE_WORDS)
                least = signatures(value, bounds)
                keys = band_keys(least).view(np.int64)
                marks = words.mix(least).astype(np.uint8)
                sizes = np.diff(bounds)
                own = [value[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                whole, less = zip(*map(_small_keys, own), strict=True) if own else ((), ())
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.md5(s.tobytes()).digest() for s in own], pa.binary()),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                        pa.array([k if n >= FEWEST else [] for k, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64())),
                        pa.array(whole, pa.int64()),
                        pa.array(less, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "marks", "keys", "whole", "less"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    return rows.mapInArrow(read, SKETCH.format(kind=kind))


def _classes(table: DataFrame) -> DataFrame:
    """One row per distinct set that is not empty, numbered by ``class``, with a document that has it."""
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    same = {name: F.first(name).alias(name) for name in ("n_shingles", "marks", "keys", "whole", "less")}
    grouped = table.where("n_shingles > 0").groupBy("set_key").agg(first.alias("_first"), *same.values())
    return grouped.select("set_key", "_first.*", *same).withColumn("class", F.monotonically_increasing_id())


# --- candidates ----------------------------------------------------------------------


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """``(key, class, n)`` of buckets with ``n`` > 1 classes."""
    rows = classes.select("class", F.explode("keys").alias("key"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counted, "key")


def _stars(shared: DataFrame) -> DataFrame:
    """``(class, hub, s)``: each class of a bucket with the bucket's hub, and how many buckets say so."""
    mass = shared.groupBy("class").agg(F.sum("n").alias("_mass"))
    weighed = shared.join(mass, "class")
    hubs = weighed.groupBy("key").agg(F.max_by("class", F.struct("_mass", -F.col("class"))).alias("hub"))
    pairs = shared.join(hubs, "key").where(F.col("class") != F.col("hub"))
    return pairs.groupBy("class", "hub").agg(F.count("*").alias("s")).where(F.col("s") >= LEAST_SHARED)


def _small_links(classes: DataFrame) -> DataFrame:
    """Links between sets that differ by one shingle, one of them below ``FEWEST``; exact."""
    whole = classes.where("whole is not null").select(F.col("class").alias("b"), "whole")
    less = classes.where("less is not null").select(F.col("class").alias("a"), F.explode("less").alias("whole"))
    return less.join(whole, "whole").where("a != b").select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose classes aren't connected yet."""
    x = labels.select(F.col("node").alias("a"), F.col("component").alias("_x"))
    y = labels.select(F.col("node").alias("b"), F.col("component").alias("_y"))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.where(F.coalesce("_x", "a") != F.coalesce("_y", "b")).drop("_x", "_y")


def _around_hubs(pairs: DataFrame) -> DataFrame:
    """Tasks of pairs ``(a, b)`` by their hub ``b``, a hub of many members cut into parts."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("_parts"))
    part = F.pmod(F.xxhash64("a"), F.col("_parts")).cast("bigint")
    return pairs.join(parts, "b").select(F.col("b").alias("t0"), part.alias("t1"), "a", "b")


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(key, class, label)`` of the buckets whose classes aren't all connected; hot ones share a second bucket."""

    def labelled(rows: DataFrame) -> DataFrame:
        named = labels.select(F.col("node").alias("class"), "component")
        return rows.join(named, "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")

    def still_open(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("n"))
        return rows.drop("n").join(ends.where("_low != _high").drop("_low", "_high"), "key")

    rows = kept(still_open(labelled(shared)))
    hot = rows.where(F.col("n") > BUCKET).select("class", "label", F.col("key").alias("_first"))
    seconds = shared.select("class", F.col("key").alias("_second"))
    both = F.xxhash64(F.least("_first", "_second"), F.greatest("_first", "_second"))
    finer = hot.join(seconds, "class").where("_first != _second").select(both.alias("key"), "class", "label").distinct()
    return rows.where(F.col("n") <= BUCKET).unionByName(still_open(finer))


EDGES = "a bigint, b bigint"


def _ties(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that hold together what may still link: per bucket, a spanning forest of the pairs of
    different labels whose sizes and signatures allow a link.

    A bucket larger than ``BUCKET`` is cut into blocks and every two blocks meet.
    """
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "label")
    dealt = dealt.join(classes.select("class", "n_shingles", "marks"), "class")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            names = ("key", "i", "j", "class", "label", "n_shingles", "marks")
            for key, i, j, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (key, i, j) != group:
                    edges += _forest(held)
                    group, held = (key, i, j), []
                held.append(row)
            yield _edge_batch(edges)
        yield _edge_batch(_forest(held))

    return dealt.mapInArrow(look, EDGES).distinct()


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*edges, strict=True)) or [(), ()]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _near_sizes(size: np.ndarray, one: int) -> np.ndarray:
    return np.minimum(size, one) * LINK[1] >= np.maximum(size, one) * LINK[0]


def _forest(held: list[list]) -> list[tuple[int, int]]:
    if len(held) < 2:
        return []
    name, label, size = (np.array(c, dtype=np.int64) for c in list(zip(*held, strict=True))[:3])
    marks = np.frombuffer(b"".join(row[3] for row in held), dtype=np.uint8).reshape(len(held), BINS)
    left = np.arange(len(held))
    edges = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            may = (label[left] != label[at]) & _near_sizes(size[left], int(size[at]))
            may[may] = (marks[left[may]] == marks[at]).sum(axis=1) >= AGREE
            edges += [(int(name[i]), int(name[at])) for i in left[may]]
            front += left[may].tolist()
            left = left[~may]
    return edges


def _in_blocks(ties: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(t0, t1, t2, own, class, label)``: what is tied together is cut into blocks by its shingles, a task
    has two blocks."""
    clusters = kept(components(ties))
    sized = clusters.join(classes.select(F.col("class").alias("node"), "n_shingles"), "node")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("_n"))
    placed = sized.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_label"))
    placed = placed.join(named, F.col("node") == F.col("_node"), "left")
    return placed.select(
        F.col("component").alias("t0"), F.least("own", "_other").alias("t1"), F.greatest("own", "_other").alias("t2"),
        "own", F.col("node").alias("class"), F.coalesce("_label", "node").alias("label"),
    )


# --- verification ----------------------------------------------------------------------


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """``(class, shingles)`` of the classes in ``needed``: their texts are read again, the others don't leave the scan.

    Up to ``BROADCAST_ROWS`` classes are sent to the scan, more are joined by shuffle.
    """
    asked = kept(needed.join(classes.select("class", "doc_id", "text_key"), "class"))
    asked = asked.select("class", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    found = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("class", "_key", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                value, bounds = words.shingle_sets(words.find_words(part.column("text"), lower=True), SHINGLE_WORDS)
                names, sets = [], []
                texts = zip(part.column("class").to_pylist(), part.column("_key").to_pylist(), part.column("text"), strict=True)
                for at, (name, key, text) in enumerate(texts):
                    said = text.as_buffer() if text.is_valid else b""
                    if hashlib.md5(said).digest() == key:  # an id may be repeated with another text
                        names.append(name)
                        sets.append(value[bounds[at] : bounds[at + 1]].tobytes())
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])

    return found.mapInArrow(read, "class bigint, shingles binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if min(len(a), len(b)) * LINK[1] < max(len(a), len(b)) * LINK[0]:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared * LINK[1] >= LINK[0] * (len(a) + len(b) - shared)


def _verified(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of ``tasks(t0, t1, a, b)`` that link; ``b`` is the task's hub."""
    members = tasks.select("t0", "t1", F.col("a").alias("class"))
    hubs = tasks.select("t0", "t1", F.col("b").alias("class")).distinct()
    rows = members.withColumn("member", F.lit(True)).unionByName(hubs.withColumn("member", F.lit(False)))
    rows = rows.join(sets, "class").repartition("t0", "t1").sortWithinPartitions("t0", "t1", "member")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            edges = []
            for name, member, shingles in zip(*(batch.column(n).to_pylist() for n in ("class", "member", "shingles")), strict=True):
                one = np.frombuffer(shingles, dtype=np.uint64)
                if not member:
                    hub, own = name, one
                elif linked(one, own):
                    edges.append((name, hub))
            yield _edge_batch(edges)

    return rows.mapInArrow(test, EDGES)


def _verified_blocks(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links between different labels within each task of ``_in_blocks``, but for those that follow from others."""
    task = ["t0", "t1", "t2"]
    rows = blocks.join(sets, "class").repartition(*task).sortWithinPartitions(*task, "class")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: dict[int, tuple] = {}
        for batch in batches:
            edges = []
            names = (*task, "class", "own", "label", "shingles")
            for t0, t1, t2, name, own, label, shingles in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (t0, t1, t2) != group:
                    edges += _block_links(held, group)
                    group, held = (t0, t1, t2), {}
                held[name] = own, label, np.frombuffer(shingles, dtype=np.uint64)  # repeated rows are one class
            yield _edge_batch(edges)
        yield _edge_batch(_block_links(held, group))

    return rows.mapInArrow(test, EDGES)


def _block_links(held: dict[int, tuple], group: tuple | None) -> list[tuple[int, int]]:
    """Every pair of a task is looked at by size and finer signature, and what agrees by its full sets."""
    if len(held) < 2:
        return []
    names = list(held)
    own, label, sets = zip(*held.values(), strict=True)
    own, label = np.array(own), np.array(label)  # the label becomes that of what has been linked here
    size = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    values = np.concatenate(sets)
    marks = words.mix(signatures(values, bounds, FINE_BINS)).astype(np.uint8)
    edges = []
    for x in range(len(names) - 1):
        rest = slice(x + 1, None)
        may = (label[rest] != label[x]) & _near_sizes(size[rest], int(size[x]))
        if group[1] != group[2]:
            may &= own[rest] != own[x]
        at = np.flatnonzero(may) + x + 1
        at = at[(marks[at] == marks[x]).sum(axis=1) >= FINE_AGREE]
        if not len(at):
            continue
        lengths = size[at]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        picked = np.repeat(bounds[at] - starts[:-1], lengths) + np.arange(starts[-1])
        place = np.searchsorted(sets[x], values[picked])
        place[place == size[x]] = 0
        shared = np.add.reduceat(sets[x][place] == values[picked], starts[:-1])
        for y in at[shared * LINK[1] >= LINK[0] * (size[x] + lengths - shared)].tolist():
            if label[y] != label[x]:
                edges.append((names[y], names[x]))
                label[label == label[y]] = label[x]
    return edges


# --- all together ------------------------------------------------------------------------


def class_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(node, component)`` of the classes that link with another one."""
    shared = kept(_shared_buckets(classes))
    links = _small_links(classes)
    stars = kept(_stars(shared))
    if not stars.isEmpty():
        ends = stars.select("class").unionByName(stars.select(F.col("hub").alias("class"))).distinct()
        sets = kept(_sets(docs, classes, ends))
        best = stars.groupBy("class").agg(F.max_by("hub", F.struct("s", -F.col("hub"))).alias("b"))
        links = kept(links.unionByName(_verified(_around_hubs(best.withColumnRenamed("class", "a")), sets)))
        labels = kept(components(links))
        others = kept(_apart(stars.select(F.col("class").alias("a"), F.col("hub").alias("b")), labels))
        if not others.isEmpty():
            links = kept(links.unionByName(_verified(_around_hubs(others), sets)))
    links = kept(links)
    labels = kept(components(links))
    ties = kept(_ties(_open_rows(shared, labels), classes))
    if ties.isEmpty():
        return labels
    ends = ties.select(F.col("a").alias("class")).unionByName(ties.select(F.col("b").alias("class"))).distinct()
    more = _verified_blocks(_in_blocks(ties, classes, labels), kept(_sets(docs, classes, ends)))
    return components(links.unionByName(kept(more)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    ``docs`` has ``doc_id, text``; other columns are not read. ``component_id`` is
    the least ``doc_id`` reachable by links, itself included; ``kept`` marks it. A
    text of fewer than four words is one shingle; null and empty texts have no
    shingles, link with nothing and are kept. Repeated rows are members of one
    class, each a row of the result. A null ``doc_id`` never names a component,
    unless all of the component's ids are null, and then its ``kept`` is null.
    """
    table = kept(sketches(docs))
    classes = kept(_classes(table))
    joined = class_components(docs, classes)
    named = classes.select("set_key", "class", "doc_id").join(joined, F.col("class") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("set_key", "component").join(names, "component").select("set_key", "component_id")
    filled = table.where("n_shingles > 0").join(by_set, "set_key").select("doc_id", "n_shingles", "component_id")
    empty = table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))
