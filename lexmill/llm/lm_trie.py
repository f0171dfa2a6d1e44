"""Elias-Fano n-gram trie with quantised log probabilities.

Words are kept backwards: the first level holds predicted words, the second the
contexts seen before each. A level's ids and the pointers to the next level are
monotone sequences in Elias-Fano form: low bits packed, high bits in unary. A
context is kept relative to its word, as ``word place * contexts + context
number``, so the level is monotone and a lookup is a successor search between
the word's two pointers. Values are codes of 8 bits into a table per level.

``Trie.dump`` lays all levels out in one run of bytes, ``Trie.load`` uses such
bytes, or a memory map of them, in place.
"""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)
_ALL = np.uint64(2**64 - 1)
CODES = 256


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, end to end in 64-bit words, with a spare word at the end."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(packed: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), dtype=np.uint64)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = packed[word] >> shift
    high = np.where(shift > 0, packed[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
    return (low | high) & ((_ONE << np.uint64(width)) - _ONE)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers below ``universe``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = _pack(values & ((_ONE << np.uint64(width)) - _ONE), width)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = int(universe >> width) + n + 2
        flags = np.zeros(-(-size // 64) * 64, dtype=bool)
        flags[places] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        return cls(n, width, low, high, ones)

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the one, or zero, number ``rank`` in the high bits."""
        counts = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(counts, rank, side="right") - 1
        left = rank - counts[word]
        bits = ~self.high[word] if zeros else self.high[word].copy()
        place = np.zeros(len(rank), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & ((_ONE << np.uint64(step)) - _ONE)).astype(np.int64)
            up = left >= below
            left = np.where(up, left - below, left)
            place += np.where(up, step, 0)
            bits = np.where(up, bits >> np.uint64(step), bits)
        return (word << 6) + place

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, False) - at).astype(np.uint64)
        return high << np.uint64(self.width) | _unpack(self.low, at, self.width)

    def successor(self, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in ``[first, end)`` whose number is not below the value; ``end`` if there is none."""
        high = (values >> np.uint64(self.width)).astype(np.int64)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - high + 1, 0)
        stop = self._select(high, True) - high
        begin, stop = np.clip(begin, first, end), np.clip(stop, first, end)
        rest = values & ((_ONE << np.uint64(self.width)) - _ONE)
        while (open_ := begin < stop).any():
            middle = (begin + stop) // 2
            below = _unpack(self.low, np.where(open_, middle, 0), self.width) < rest
            begin = np.where(open_ & below, middle + 1, begin)
            stop = np.where(open_ & ~below, middle, stop)
        return begin

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype=np.int64), self.low, self.high, self.ones]


def quantise(values: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """A code of each value and the table: bins of equal width, each standing for the mean of its values."""
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1)
    low, span = values.min(), np.ptp(values)
    code = np.minimum(((values - low) / (span or 1) * codes).astype(np.int64), codes - 1)
    n = np.bincount(code, minlength=codes)
    total = np.bincount(code, weights=values, minlength=codes)
    return code.astype(np.uint8), np.divide(total, n, out=np.zeros(codes), where=n > 0)


class Trie:
    """Two levels: words with counts and log10 probabilities, and their contexts with log10 numerators."""

    def __init__(self, parts: list[np.ndarray]):
        shape, parts = parts[0], list(parts[1:])
        self.universe = int(shape[0])
        levels = []
        for _ in range(4):
            head, low, high, ones = parts[:4]
            levels.append(EliasFano(int(head[0]), int(head[1]), low, high, ones))
            parts = parts[4:]
        self.words, self.contexts, self.pointers, self.pairs = levels
        self.counts, self.word_code, self.word_table, self.pair_code, self.pair_table = parts

    @classmethod
    def build(
        cls, words: np.ndarray, counts: np.ndarray, word_values: np.ndarray, owner: np.ndarray, contexts: np.ndarray, pair_values: np.ndarray
    ) -> list[np.ndarray]:
        """Parts of a trie: sorted distinct ``words``; pairs sorted by (``owner`` word place, ``contexts`` hash)."""
        known = np.unique(contexts)
        relative = owner.astype(np.uint64) * np.uint64(len(known)) + np.searchsorted(known, contexts).astype(np.uint64)
        pointers = np.searchsorted(owner, np.arange(len(words) + 1))
        out = [np.array([len(known)], dtype=np.int64)]
        full = 2**64 - 1
        for values, universe in ((words, full), (known, full), (pointers, len(owner)), (relative, len(words) * len(known))):
            out += EliasFano.build(values, universe).parts()
        return [*out, counts.astype(np.int64), *quantise(word_values), *quantise(pair_values)]

    @staticmethod
    def dump(parts: list[np.ndarray]) -> bytes:
        head = [np.array([len(parts)], dtype=np.int64)]
        for part in parts:
            head.append(np.array([np.dtype(part.dtype).num, len(part)], dtype=np.int64))
        return b"".join([*(h.tobytes() for h in head), *(p.tobytes().ljust(-(-p.nbytes // 8) * 8, b"\0") for p in parts)])

    @classmethod
    def load(cls, data) -> Trie:
        """A trie on ``data``, anything with the bytes of ``dump``; nothing is copied."""
        n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
        head = np.frombuffer(data, dtype=np.int64, count=2 * n, offset=8).reshape(n, 2)
        kinds = {np.dtype(k).num: np.dtype(k) for k in (np.int64, np.uint64, np.float64, np.uint8)}
        at, parts = 8 + 16 * n, []
        for number, size in head.tolist():
            parts.append(np.frombuffer(data, dtype=kinds[number], count=size, offset=at))
            at += -(-size * kinds[number].itemsize // 8) * 8
        return cls(parts)

    @classmethod
    def mapped(cls, parts: list[np.ndarray]) -> Trie:
        """The trie in memory-mapped pages that belong to no file."""
        data = cls.dump(parts)
        pages = mmap.mmap(-1, len(data))
        pages.write(data)
        return cls.load(pages)

    def find_words(self, words: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for unknown ones."""
        return _found(self.words, words, np.zeros(len(words), dtype=np.int64), np.full(len(words), self.words.n))

    def find_pairs(self, place: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Place of each (known word, context) pair, -1 for unseen ones."""
        out = np.full(len(place), -1, dtype=np.int64)
        number = _found(self.contexts, contexts, np.zeros(len(place), dtype=np.int64), np.full(len(place), self.contexts.n))
        ok = np.flatnonzero((number >= 0) & (place >= 0))
        place = place[ok]
        value = place.astype(np.uint64) * np.uint64(self.universe) + number[ok].astype(np.uint64)
        first, end = (self.pointers.get(x).astype(np.int64) for x in (place, place + 1))
        out[ok] = _found(self.pairs, value, first, end)
        return out


def _found(level: EliasFano, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not level.n or not len(values):
        return np.full(len(values), -1, dtype=np.int64)
    at = level.successor(values, first, end)
    inside = at < end
    hit = inside & (level.get(np.where(inside, at, 0)) == values)
    return np.where(hit, at, -1)
