"""Benchmark decontamination by size-partitioned MinHash containment search.

Containment of an item in a document is the share of the item's distinct
five-word shingles that the document has. Items are partitioned by size
(powers of two), and an item's signature is its minimum under each of the
partition's hash permutations. A minimum is one of the item's own shingles, so
the share of minima found among a document's shingles estimates containment
without bias however long the document is, and a document never needs a sketch of
its own. Each partition has its own number of minima and asks for as many found
ones as miss a contained item with a chance of at most ``MISS``: up to three
shingles all must be found, since 0.8 of them is all of them. Documents too short
for an item skip it. What is found is verified by counting the shared shingles.

Items are asked in blocks of a bounded number of shingles. A pass shingles each
document once and asks ``BLOCKS_A_PASS`` blocks, of which a task holds one at a
time; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import words
from lexmill.llm.common import opened, unused

SIGNATURE = 64  # most minima of an item
MISS = 1e-12
BLOCK_SHINGLES = 1 << 20
BLOCKS_A_PASS = 16
SIMILARITY = (4, 5)
_FILTER_BITS = 22
_SALTS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, SIGNATURE, dtype=np.uint64)


def least_found(minima: int, share: float, miss: float = MISS) -> int:
    """The largest m such that fewer than m of ``minima`` hits, each of chance ``share``, come with chance <= ``miss``."""
    total = 0.0
    for found in range(minima + 1):
        total += math.comb(minima, found) * share**found * (1 - share) ** (minima - found)
        if total > miss:
            return max(found, 1)
    return minima


@cache
def partition_of(size: int) -> tuple[int, int]:
    """``(minima, least number of them to be found)`` of the size partition that has items of ``size`` shingles."""
    low = 1 << (int(size).bit_length() - 1)
    # among five sizes in a row is one of which exactly 0.8 may be asked
    share = min(-(-n * SIMILARITY[0] // SIMILARITY[1]) / n for n in range(low, min(2 * low, low + SIMILARITY[1])))
    minima = SIGNATURE if share < 1 else min(SIGNATURE, 4 * low)
    return minima, least_found(minima, share)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The item's minimum under each permutation of its partition."""
    salts = _SALTS[: partition_of(len(shingles))[0]]
    out = np.empty(len(salts), dtype=np.uint64)
    step = max(1, (1 << 18) // len(shingles))  # permutations at once
    for k in range(0, len(salts), step):
        out[k : k + step] = shingles[words.mix(shingles[None, :] ^ salts[k : k + step, None]).argmin(axis=1)]
    return out


@dataclass
class ItemIndex:
    """Signatures of a block of items, as sorted arrays.

    ``values`` are minima; ``entries[first[i]:first[i + 1]]`` are the items of value
    i and ``weights`` for how many permutations it is the minimum.
    """

    item_ids: np.ndarray
    sizes: np.ndarray  # distinct shingles
    lengths: np.ndarray  # words of items with fewer words than a shingle, else 0
    needed: np.ndarray  # minima to be found
    shingles: np.ndarray  # of all items, end to end
    values: np.ndarray
    first: np.ndarray
    entries: np.ndarray
    weights: np.ndarray
    filter: np.ndarray

    @classmethod
    def build(cls, item_ids: list[int], lengths: list[int], shingles: list[np.ndarray], signatures: list[np.ndarray]) -> ItemIndex:
        none = np.zeros(0, dtype=np.uint64)
        sizes = np.array([len(s) for s in shingles], dtype=np.int64)
        needed = np.array([partition_of(n)[1] for n in sizes], dtype=np.int64)
        entry = np.repeat(np.arange(len(sizes)), [len(s) for s in signatures])
        value = np.concatenate([none, *signatures])
        order = np.lexsort((entry, value))
        value, entry = value[order], entry[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (entry[1:] != entry[:-1])
        weights = np.diff(np.r_[np.flatnonzero(new), len(value)])
        value, entry = value[new], entry[new]
        values, first = np.unique(value, return_index=True)
        has = np.zeros(1 << _FILTER_BITS, dtype=bool)
        has[(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        first = np.r_[first, len(value)].astype(np.int64)
        own = np.concatenate([none, *shingles])
        return cls(np.array(item_ids, dtype=np.int64), sizes, np.array(lengths, dtype=np.int64), needed, own, values, first, entry, weights, has)

    def matches(self, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, item, shared)`` of verified containments; ``value`` holds sorted shingles per document."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.values) or not len(value):
            return none, none, none
        maybe = np.flatnonzero(self.filter[(value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, value[maybe]), len(self.values) - 1)
        hit = self.values[at] == value[maybe]
        at, place = at[hit], maybe[hit]
        doc = np.searchsorted(bounds, place, side="right") - 1
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc = np.repeat(doc, n)
        pair, where = np.unique(doc * len(self.sizes) + self.entries[entry], return_inverse=True)
        found = np.bincount(where, weights=self.weights[entry], minlength=len(pair))
        doc, item = np.divmod(pair, len(self.sizes))
        large = np.diff(bounds)[doc] * SIMILARITY[1] >= self.sizes[item] * SIMILARITY[0]
        good = (found >= self.needed[item]) & (large | (self.lengths[item] > 0))
        doc, item = doc[good], item[good]
        ends = np.cumsum(self.sizes)
        own = [self.shingles[ends[i] - self.sizes[i] : ends[i]] for i in item]
        shared = np.array([_shared(s, value[bounds[d] : bounds[d + 1]]) for s, d in zip(own, doc, strict=True)], dtype=np.int64)
        good = shared * SIMILARITY[1] >= self.sizes[item] * SIMILARITY[0]
        return doc[good], item[good], shared[good]


def _shared(item: np.ndarray, document: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(document, item), len(document) - 1)
    return int((document[at] == item).sum())


def _with_short(found: words.Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of each text, and with them all its word sequences of the ``lengths`` below a shingle."""
    value, bounds = words.shingle_sets(found)
    if not lengths:
        return value, bounds
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes, owner = words.word_hashes(found), found.rows()
    parts = [(value, row)]
    for size in lengths:
        grams = words.sequence_hashes(hashes, size)
        whole = owner[: len(grams)] == owner[size - 1 :] if len(grams) else np.zeros(0, dtype=bool)
        parts.append((grams[whole], owner[: len(grams)][whole]))
    value, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((value, row))
    return value[order], np.searchsorted(row[order], np.arange(len(bounds)))


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", block: int = BLOCK_SHINGLES) -> Iterator[ItemIndex]:
    """Indexes of all items, about ``block`` shingles each. Repeated rows count once; items without words are left out."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "_text"):
                found = words.find_words(part.column("_text"), lower=True)
                value, bounds = words.shingle_sets(found)
                counts = found.counts
                lengths = np.where(counts < words.SHINGLE_WORDS, counts, 0)
                sets = [value[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                data = [own.tobytes() for own in sets]
                minima = [signature(own).tobytes() if len(own) else b"" for own in sets]
                yield pa.record_batch(
                    [part.column("_key"), pa.array(lengths), pa.array(np.diff(bounds)), pa.array(data, pa.binary()), pa.array(minima, pa.binary())],
                    names=["item_id", "words", "n", "shingles", "minima"],
                )

    rows = items.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).dropDuplicates()
    sets = rows.mapInArrow(prepare, "item_id bigint, words bigint, n bigint, shingles binary, minima binary").where("n > 0 and item_id is not null")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block))
    for k in range(blocks):
        own = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "words", "n").collect()  # one bounded block
        arrays = ([np.frombuffer(r[name], dtype=np.uint64) for r in own] for name in ("shingles", "minima"))
        yield ItemIndex.build([r["item_id"] for r in own], [r["words"] for r in own], *arrays)


def _passes(items: DataFrame, block: int) -> Iterator[list[tuple[Broadcast, list[int]]]]:
    """All blocks broadcast, as many together as a pass asks, each with the lengths of its items below a shingle."""
    spark = items.sparkSession.sparkContext
    blocks = ((spark.broadcast(index), sorted({int(n) for n in index.lengths if n})) for index in item_blocks(items, block=block))
    while some := list(islice(blocks, BLOCKS_A_PASS)):
        yield some


FOUND = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "item_shingles", "shared_shingles")])
)


def with_matches(docs: DataFrame, blocks: list[tuple[Broadcast, list[int]]], text: str = "text", name: str = "_matches") -> DataFrame:
    """``docs`` with all their columns and ``name``: the items of the blocks that each document contains."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    short = sorted({n for _, lengths in blocks for n in lengths})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.record_batch(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for part in words.slices(batch, str(place)):
                value, bounds = _with_short(words.find_words(part.column(place), lower=True), short)
                found = []
                for block, _ in blocks:
                    with opened(block, keep=len(blocks) == 1) as own:
                        doc, item, n = own.matches(value, bounds)
                        found.append((doc, own.item_ids[item], own.sizes[item], n))
                doc, *fields = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[order], np.arange(part.num_rows + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(f[order], pa.int64()) for f in fields], names=FOUND.elementType.names)
                matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
                yield pa.record_batch([*part.columns, matches], names=schema.names)

    return docs.mapInArrow(search, schema)


def contained_items(docs: DataFrame, items: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, item_id, item_shingles, shared_shingles, containment)`` of all items contained by 0.8 or more.

    ``docs`` has ``doc_id, text``, ``items`` ``item_id, text``. Words are compared
    with A-Z in lower case. An item of fewer than five words is one shingle, its
    whole word sequence, and is found wherever a text has it. Null and empty
    texts contain nothing, items without words or id are in nothing. Repeated
    documents are reported each, repeated items once.
    """
    out = None
    for blocks in _passes(items, block):
        found = with_matches(docs.select("doc_id", "text"), blocks).select("doc_id", F.inline("_matches"))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def without_benchmark(docs: DataFrame, items: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay."""
    out = docs
    for blocks in _passes(items, block):
        (name,) = unused(out, "_matches")
        out = with_matches(out, blocks, name=name).where(F.size(name) == 0).drop(name)
    return out
