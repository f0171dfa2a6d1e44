"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of arrays.

Pre-tokens of a batch are one ragged array of symbols. In each round every
sequence applies its own lowest-ranked pair, all its places at once, until no
sequence has a pair left; what survives is counted. A pair made by a merge has
always a higher rank than that merge, so rounds follow the order of the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexmill.llm import words

# Fixed values of byte-level BPE: the white space characters and the split pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

TOKEN_LIMIT = 512
PIECE_CHARS = 1 << 19
KEPT_COUNTS = 1 << 19
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in plain else next(others)) for byte in range(256)]


class Merges:
    """Merge table of a vocabulary: ``count(pre-tokens)`` gives the number of symbols left of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[letter] for letter in byte_letters()], dtype=np.int64)
        self.specials = [token["content"] for token in spec.get("added_tokens", []) if token["content"]]
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        left, right = (np.array([vocab[pair[k]] for pair in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys = (left << 32 | right)[order]
        self.ranks = order.astype(np.int32)
        self.made = made
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols that each non-empty pre-token ends with."""
        coded = [token.encode() for token in tokens]
        sizes = np.array([len(code) for code in coded], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(coded)), sizes)
        rank = np.full(len(symbols), _NONE, dtype=np.int32)  # of the pair that begins at each symbol
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        out = np.zeros(len(coded), dtype=np.int64)
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[begins, len(owner)])
            best = np.minimum.reduceat(rank, begins)
            open_ = best < _NONE
            ended = ~open_
            out[owner[begins[ended]]] = lengths[ended]
            live = np.repeat(open_, lengths)
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            if not len(symbols):
                break
            hit = rank == np.repeat(best[open_], lengths[open_])
            hit = self._apart(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[at + 1] = False
            symbols, owner, rank, hit = symbols[stays], owner[stays], rank[stays], hit[stays]
            again = hit.copy()
            again[:-1] |= hit[1:]
            again = np.flatnonzero(again)
            rank[again] = _NONE
            again = again[again < len(symbols) - 1]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self._rank(symbols[again], symbols[again + 1])
        return out

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of touching places (a symbol that repeats) every second one, from the left."""
        at = np.flatnonzero(hit)
        if len(at) < 2 or not (at[1:] == at[:-1] + 1).any():
            return hit
        first = np.r_[True, at[1:] != at[:-1] + 1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        hit[at[(np.arange(len(at)) - start) % 2 == 1]] = False
        return hit

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens - self.known.keys())
        if len(self.known) + len(new) > KEPT_COUNTS:
            self.known.clear()
            new = list(tokens)
        if new:
            self.known.update(zip(new, self.count(new).tolist(), strict=True))

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text no pre-token reaches across: a cut is where white space follows other text."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            found = _CUT.search(text, start + PIECE_CHARS)
            if not found:
                break
            yield text[start : found.end()]
            start = found.end()
        yield text[start:]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Special strings count one each and end the text around them."""
        totals = [0] * len(texts)
        group: list[tuple[int, list[str]]] = []
        held = 0
        for row, text in enumerate(texts):
            parts = self.cut.split(text) if self.specials else [text]
            totals[row] += len(parts) - 1
            for part in parts:
                for piece in self.pieces(part):
                    group.append((row, self.split.findall(piece)))
                    held += len(piece)
                    if held >= PIECE_CHARS:
                        self._add(group, totals)
                        group, held = [], 0
        self._add(group, totals)
        return totals

    def _add(self, group: list[tuple[int, list[str]]], totals: list[int]) -> None:
        self.learn(set().union(*(tokens for _, tokens in group)))
        known = self.known.__getitem__
        for row, tokens in group:
            totals[row] += sum(map(known, tokens))


_CUT = regex.compile(rf"[^{SPACE}](?=[{SPACE}])")
_LOADED: dict[str, Merges] = {}


def token_counts(df: DataFrame, vocabulary: str, limit: int = TOKEN_LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of whole texts under a ``tokenizer.json`` vocabulary.

    ``vocabulary`` is a path every executor can read. Null texts count as empty
    (no bytes, no tokens). Repeated rows are counted each. Other columns are
    not read. A task holds one slice of texts and a bounded table of known
    pre-tokens; a long text is split where no pre-token reaches across.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _LOADED.get(vocabulary) or _LOADED.setdefault(vocabulary, Merges(vocabulary))
        for batch in batches:
            for part in words.slices(batch, "_text"):
                n_bytes = np.diff(words.text_buffer(part.column("_text"))[1])
                n_tokens = np.array(merges.counts([t or "" for t in part.column("_text").to_pylist()]), dtype=np.int64)
                yield pa.record_batch(
                    [part.column("_key"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
