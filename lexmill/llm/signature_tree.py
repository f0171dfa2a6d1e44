"""Signature tree over shingle sets: which sets are connected by a Jaccard similarity of 0.8 or more.

A node holds the OR of the bitmaps below it, the least and greatest set size and
the most bits lost to collisions. Two sets can share at most the bits that both
bitmaps have, and the lost ones; two nodes whose possible overlap is less than a
link between their sizes needs are never opened, and neither are nodes whose
sets are all in one component already.
"""

from __future__ import annotations

import numpy as np

FAN_OUT = 16
LEAST_BITS, MOST_BITS = 512, 1 << 15
LINK = (4, 5)  # intersection : union


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum()) if len(b) else 0
    return shared > 0 and shared * LINK[1] >= LINK[0] * (len(a) + len(b) - shared)


class Tree:
    """Levels from the sets up; ``levels[0]`` are the sets in order, each next has a node for ``FAN_OUT`` of the last."""

    def __init__(self, sets: list[np.ndarray], order: list | None = None):
        self.place = np.arange(len(sets)) if order is None else np.array(sorted(range(len(sets)), key=order.__getitem__))
        self.sets = [sets[i] for i in self.place]
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        bits = LEAST_BITS
        while bits < min(4 * int(sizes.max(initial=1)), MOST_BITS):
            bits *= 2
        flags = np.zeros((len(sets), bits), dtype=bool)
        for i, own in enumerate(self.sets):
            flags[i, (own % np.uint64(bits)).astype(np.int64)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        lost = sizes - flags.sum(axis=1)
        self.maps, self.least, self.most, self.lost = [maps], [sizes], [sizes], [lost]
        while len(self.maps[-1]) > FAN_OUT:
            cuts = np.arange(0, len(self.maps[-1]), FAN_OUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], cuts, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], cuts))
            self.most.append(np.maximum.reduceat(self.most[-1], cuts))
            self.lost.append(np.maximum.reduceat(self.lost[-1], cuts))
        self.root = np.arange(len(sets))

    def _top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets below node i and below node j can link, by size ranges and possible overlap."""
        low_i, low_j = self.least[level][i], self.least[level][j]
        top_i, top_j = self.most[level][i], self.most[level][j]
        may = (top_i * LINK[1] >= low_j * LINK[0]) & (top_j * LINK[1] >= low_i * LINK[0])
        i, j = i[may], j[may]
        maps = self.maps[level]
        common = np.bitwise_count(maps[i] & maps[j]).sum(axis=1).astype(np.int64)
        overlap = np.minimum(common + np.minimum(self.lost[level][i], self.lost[level][j]), np.minimum(top_i[may], top_j[may]))
        # intersection >= 4/5 union is the same as 9 intersection >= 4 (|a| + |b|)
        may[may] = overlap * (LINK[0] + LINK[1]) >= LINK[0] * (low_i[may] + low_j[may])
        return may

    def connect(self) -> np.ndarray:
        """The component of each set, by its first member's place in the given order."""
        tops = len(self.maps) - 1
        n = len(self.maps[tops])
        i, j = np.triu_indices(n)
        todo = [(tops, i, j)]
        while todo:
            level, i, j = todo.pop()
            good = self._may_link(level, i, j) if level or len(i) else np.zeros(0, dtype=bool)
            i, j = i[good], j[good]
            if not level:
                self._verify(i, j)
                continue
            below = len(self.maps[level - 1])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if self._together(level, a, b):
                    continue
                own = np.arange(a * FAN_OUT, min((a + 1) * FAN_OUT, below))
                other = np.arange(b * FAN_OUT, min((b + 1) * FAN_OUT, below))
                x, y = np.repeat(own, len(other)), np.tile(other, len(own))
                ordered = x <= y
                todo.append((level - 1, x[ordered], y[ordered]))
        out = np.empty(len(self.sets), dtype=np.int64)
        out[self.place] = self.place[[self._top(i) for i in range(len(self.sets))]]
        return out

    def _together(self, level: int, a: int, b: int) -> bool:
        step = FAN_OUT**level
        places = [*range(a * step, min((a + 1) * step, len(self.sets))), *range(b * step, min((b + 1) * step, len(self.sets)))]
        first = self._top(places[0])
        return all(self._top(i) == first for i in places)

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if a == b:
                continue
            top_a, top_b = self._top(a), self._top(b)
            if top_a != top_b and linked(self.sets[a], self.sets[b]):
                self.root[max(top_a, top_b)] = min(top_a, top_b)
