"""Words, word hashes and shingles of Arrow text columns, as numpy arrays.

Words are the runs of bytes other than blank and \\t \\n \\v \\f \\r. All work is done
on slices of a bounded number of bytes, so its memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over their whole range; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in ``data``, and ``bounds[i]`` the first word of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, or a single row that is larger."""
    offsets = text_buffer(batch.column(column))[1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def find_words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word does not reach over into the next text
    begins[edges] |= inside[1:-1][edges]
    before = edges[edges > 0] - 1
    stops[before] |= inside[1:-1][before]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def _powers(span: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``span``; kept for spans of usual size."""
    if span > _HASH_BLOCK:
        return _power(_BASE, span), _power(_INVERSE, span)
    if not _KEPT:
        _KEPT.extend((_power(_BASE, _HASH_BLOCK), _power(_INVERSE, _HASH_BLOCK)))
    return _KEPT[0], _KEPT[1]


def _power(base: np.uint64, span: int) -> np.ndarray:
    out = np.full(span + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_KEPT: list[np.ndarray] = []


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, in blocks so that a very long text needs no more memory than many short ones."""
    out = np.empty(len(words.starts), dtype=np.uint64)
    first = 0
    while first < len(out):
        start = words.starts[first]
        last = max(first + 1, int(np.searchsorted(words.ends, start + _HASH_BLOCK, side="right")))
        begin, end = words.starts[first:last] - start, words.ends[first:last] - start
        span = int(end[-1])
        power, back = _powers(span)
        total = np.zeros(span + 1, dtype=np.uint64)
        np.cumsum(_BYTE[words.data[start : start + span]] * power[:span], out=total[1:])
        out[first:last] = (total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64)
        first = last
    return mix(out)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; positions without so many words are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACES[k]
    return mix(total)


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """As ``gram_hashes``, for sequences shorter than a shingle that stand for themselves."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACES[k]
    return mix(total + np.uint64(size))


def shingle_sets(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and the bounds of each text.

    A text of fewer than ``size`` words has its whole sequence as one shingle, an
    empty one has none.
    """
    hashes, counts = word_hashes(words), words.counts
    grams = gram_hashes(hashes, size)
    row = words.rows()[: len(grams)]
    whole = np.arange(len(grams)) + size <= words.bounds[1:][row] if len(grams) else np.zeros(0, dtype=bool)
    values, owner = [grams[whole]], [row[whole]]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        at = words.bounds[few]
        total = np.zeros(len(few), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[few] > k
            total[has] += hashes[at[has] + k] * _PLACES[k]
        values.append(mix(total + counts[few].astype(np.uint64)))
        owner.append(few)
    value, row = np.concatenate(values), np.concatenate(owner)
    if len(few):
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    edges = np.searchsorted(row, np.arange(len(counts) + 1)).tolist()
    for first, last in zip(edges, edges[1:], strict=False):
        value[first:last].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))
