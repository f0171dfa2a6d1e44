"""Compressed FM-index over word sequences: a wavelet matrix over the Burrows-Wheeler transform.

Sequences are laid end to end with a separator after each. Suffixes are ordered
to a depth of ``DEPTH`` words, which is enough to search patterns shorter than
that: rows that differ later only swap places inside one interval. Bits are
packed 64 to a word with a running count per word.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletMatrix:
    """Rank of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            one = (now >> level & 1).astype(bool)
            packed = np.packbits(np.r_[one, np.zeros(64 - len(one) % 64, dtype=bool)], bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(len(one) - one.sum()))
            now = np.concatenate([now[~one], now[one]])
        every = np.arange(sigma)
        self.start = self._down(every, np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            up = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(up, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` symbols, by doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    done = 1
    while True:
        key = rank * (n + 2)
        key[: n - done] += rank[done:] + 1
        order = np.argsort(key, kind="stable") if done >= depth // 2 else np.argsort(key)
        placed = key[order]
        steps = np.zeros(n, dtype=np.int64)
        steps[1:] = np.cumsum(placed[1:] != placed[:-1])
        done *= 2
        if done >= depth or steps[-1] == n - 1:
            return order
        rank[order] = steps


class FMIndex:
    """Index of sequences given end to end; ``weights`` say how often each stands in the corpus."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, weights: np.ndarray):
        vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n_seq = len(bounds) - 1
        self.sigma = len(vocabulary) + 1
        lengths = np.diff(bounds)
        self.starts = bounds[:-1] + np.arange(n_seq)
        self.ends = self.starts + lengths
        self.text = np.zeros(len(hashes) + n_seq, dtype=np.int64)
        keep = np.ones(len(self.text), dtype=bool)
        keep[self.ends] = False
        self.text[keep] = symbols.ravel() + 1
        order = suffix_order(self.text)
        self.matrix = WaveletMatrix(self.text[order - 1], self.sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(self.text, minlength=self.sigma))]
        owner = np.repeat(np.arange(n_seq), lengths + 1)
        self.weight = np.r_[0, np.cumsum(weights[owner[order]])]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` before what the intervals stand for: one step of backward search."""
        both = self.matrix.rank(np.r_[symbol, symbol], np.r_[low, high]) + np.tile(self.before[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def repeated(self, least: int, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the indexed sequences themselves: ``(sequence, first, end)``.

        Intervals, from each sequence's start, that stand at least ``times``
        times in the corpus and are at least ``least`` long; they cover every
        window of ``least`` symbols that does. A search goes left from a right
        end until too few occurrences are left at some place. If it got less
        than ``least`` far, short searches that end just right of that place find
        a small piece that is too rare, and no window holding it is tried again.
        """
        total = len(self.text)
        seq = np.flatnonzero(self.ends - self.starts >= least)
        right = self.ends[seq].copy()
        at = right.copy()
        low, high = np.zeros(len(seq), dtype=np.int64), np.full(len(seq), total)
        left = self.starts[seq]  # where the running search stops
        bar = np.full(len(seq), -1)  # the place a probe is about, -1 in a full search
        far, size = np.zeros(len(seq), dtype=np.int64), np.zeros(len(seq), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seq):
            low, high = self.extend(self.text[at - 1], low, high)
            good = self.weight[high] - self.weight[low] >= times
            at = np.where(good, at - 1, at)
            stop = ~good | (at == left)
            if stop.any():
                probing = bar >= 0
                full = stop & ~probing
                got = right - at
                hit = full & (got >= least)
                if hit.any():
                    found.append((seq[hit], at[hit] - self.starts[seq[hit]], right[hit] - self.starts[seq[hit]]))
                # a full search that got far: on with the window that begins at the place that failed
                following = np.where(hit, at - 1 + least, right)
                # one that did not: probe from the place that failed
                fails = full & ~hit
                probe_again = stop & probing & good
                probe_ends = stop & probing & ~good
                bar = np.where(fails, at - 1, bar)
                far = np.where(fails, right, far)
                size = np.where(fails, 2, np.where(probe_again, size * 2, size))
                launch = (fails | probe_again) & (bar + size < far)
                give_up = (fails | probe_again) & ~launch
                following = np.where(probe_ends, bar + size - 1, following)
                following = np.where(give_up, far - 1, following)
                right = np.where(launch, bar + size, np.where(stop, following, right))
                left = np.where(launch, bar, np.where(stop, self.starts[seq], left))
                bar = np.where(stop & ~launch, -1, bar)
                at = np.where(stop, right, at)
                low, high = np.where(stop, 0, low), np.where(stop, total, high)
                over = stop & ~launch & (right - self.starts[seq] < least)
                if over.any():
                    on = ~over
                    seq, right, at, low, high, left, bar, far, size = (x[on] for x in (seq, right, at, low, high, left, bar, far, size))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
