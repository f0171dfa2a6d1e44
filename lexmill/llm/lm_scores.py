"""Language-model scores of whole texts from a sharded Elias-Fano n-gram trie.

The model is a Dirichlet-smoothed bigram: ``p(w | h) = (c(h, w) + m p(w)) / (c(h) + m)``
with ``p`` the word frequencies, of which the share of words seen once is set
aside for unknown words. A text ends with an end token, which is also the
context of its first word. So a text's contexts are the same tokens as its
words, and its score is the sum of the numerators' logarithms, which the pair's
shard knows, less that of the denominators, which the word's shard knows. One
shuffle of the tokens with their contexts serves training and scoring.

* Tokens are dealt to shards by word, a bounded number of bytes each, as packed
  blocks; a shard counts its training pairs, builds its trie and asks it. It
  answers a block with the word's count and the pair's numerator per token, some
  six bytes; the block's texts are summed up where its answers meet. So what is
  moved is in proportion to the tokens, however many shards there are.
* Words above a ten-thousandth of all tokens are dealt by word and context.
  Their counts, and those of frequent pairs among them, are found in two passes
  before, and travel with the tasks: at most ten thousand words, and pairs above
  a millionth of the tokens. What such a pair adds never leaves its task.
* Sums are whole numbers of 1e-9, so reruns agree to the last digit.
* Within a shard a word is told by 48 bits of its hash, a context by 32.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import words
from lexmill.llm.common import fold_array, text_bytes
from lexmill.llm.lm_trie import Trie

HELD_OUT_FOLD = 1
PRIOR = 1000.0
SHARD_BYTES = 12 << 20
SLICE_BYTES = 3 << 20
HOT_WORDS, HOT_PAIRS = 10_000, 1_000_000  # a hot word is above one such part of all tokens
LEAST_HOT_WORD, LEAST_HOT_PAIR = 10_000, 1_000
END = np.uint64(0x5851F42D4C957F2D)  # the end token among word hashes
UNIT = 1e9
_KEPT_PAIRS = 1 << 21


@dataclass
class Totals:
    """Training tokens, distinct words, words seen once, and the hot words with their counts."""

    tokens: int
    distinct: int
    single: int
    hot: np.ndarray
    hot_counts: np.ndarray
    prior: float = PRIOR
    pairs: list[np.ndarray] | None = None  # the parts of the hot pairs' trie

    @property
    def unknown(self) -> float:
        """Probability of the class of unknown words."""
        return (self.single + 0.5) / (self.tokens + 1) if self.tokens else 1.0

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the word probabilities."""
        known = (1 - self.unknown) * counts / max(self.tokens, 1)
        return np.log10(np.where(counts > 0, known, self.unknown))

    def hot_place(self, values: np.ndarray) -> np.ndarray:
        """Place among the hot words, -1 for others."""
        if not len(self.hot):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.hot, values), len(self.hot) - 1)
        return np.where(self.hot[at] == values, at, -1)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, context, row)`` of all tokens of a run of texts; each text ends with ``END``."""
    found = words.find_words(part.column("text"), lower=True)
    n = found.counts
    row = np.repeat(np.arange(len(n)), n + 1)
    word = np.full(len(row), END)
    last = np.cumsum(n + 1) - 1
    inner = np.ones(len(row), dtype=bool)
    inner[last] = False
    word[inner] = words.word_hashes(found)
    context = np.r_[END, word[:-1]] if len(word) else word
    return word, context, row


def _training(part: pa.RecordBatch) -> np.ndarray:
    return fold_array(part.column("doc_id")) != HELD_OUT_FOLD


def _shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return (words.mix(values ^ np.uint64(0xA5A5A5A5)) % np.uint64(shards)).astype(np.int64)


def _totals(docs: DataFrame, shards: int, n_bytes: int) -> Totals:
    """Counts over all training texts: packed partial counts, summed per shard; one row per shard and the hot words reach the driver."""
    floor = min(LEAST_HOT_WORD, max(1, n_bytes // (10 * HOT_WORDS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                word, _, row = tokens(part)
                value, n = np.unique(word[_training(part)[row]], return_counts=True)
                shard = _shard_of(value, shards)
                order = np.argsort(shard, kind="stable")
                value, n = value[order], n[order].astype(np.int64)
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.record_batch(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([value[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary()),
                        pa.array([n[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary()),
                    ],
                    names=["shard", "word", "n"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:  # a partition holds whole shards
            more = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column("word")]
            counts = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column("n")]
            value, where = np.unique(np.concatenate([value, *more]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([n, *counts]), minlength=len(value)).astype(np.int64)
        hot = n > floor
        yield pa.record_batch(
            [
                pa.array([int(n.sum())], pa.int64()),
                pa.array([len(n)], pa.int64()),
                pa.array([int((n == 1).sum())], pa.int64()),
                pa.array([value[hot].tobytes()], pa.binary()),
                pa.array([n[hot].tobytes()], pa.binary()),
            ],
            names=["tokens", "distinct", "single", "hot", "hot_n"],
        )

    partial = docs.mapInArrow(count, "shard int, word binary, n binary")
    summed = partial.repartitionById(shards, F.col("shard")).mapInArrow(add, "tokens bigint, distinct bigint, single bigint, hot binary, hot_n binary")
    rows = summed.where("tokens > 0").collect()  # one short row per partition
    tokens_ = sum(r["tokens"] for r in rows)
    hot = np.concatenate([np.frombuffer(r["hot"], dtype=np.uint64) for r in rows] or [np.zeros(0, dtype=np.uint64)])
    counts = np.concatenate([np.frombuffer(r["hot_n"], dtype=np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)])
    above = (counts > max(floor, tokens_ // HOT_WORDS)) & (counts >= min(LEAST_HOT_WORD, floor + 1))
    order = np.argsort(hot[above])
    return Totals(tokens_, sum(r["distinct"] for r in rows), sum(r["single"] for r in rows), hot[above][order], counts[above][order])


def _hot_pairs(docs: DataFrame, totals: Totals) -> list[np.ndarray]:
    """The trie of frequent pairs among the hot words."""
    n_hot = len(totals.hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                word, context, row = tokens(part)
                place = totals.hot_place(word)
                before = np.r_[totals.hot_place(context[:1]), place[:-1]]  # each context is the word before
                both = (place >= 0) & (before >= 0) & _training(part)[row]
                more, counts = np.unique(place[both] * n_hot + before[both], return_counts=True)
                code, where = np.unique(np.r_[code, more], return_inverse=True)
                n = np.bincount(where, weights=np.r_[n, counts], minlength=len(code)).astype(np.int64)
                if len(code) > _KEPT_PAIRS:
                    yield out()
                    code, n = code[:0], n[:0]
        yield out()

    least = max(totals.tokens // HOT_PAIRS, LEAST_HOT_PAIR)
    rows = docs.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    found = sorted((r["code"], r["n"]) for r in rows.where(F.col("n") > least).collect())  # at most one in a millionth of the tokens
    code = np.array([c for c, _ in found], dtype=np.int64)
    n = np.array([c for _, c in found], dtype=np.int64)
    owner, before = np.divmod(code, max(n_hot, 1))
    order = np.lexsort((totals.hot[before], owner))
    owner, context, n = owner[order], totals.hot[before][order], n[order]
    values = totals.unigram(totals.hot_counts)
    pair = np.log10(n + totals.prior * 10 ** values[owner]) if len(owner) else np.zeros(0)
    return Trie.build(totals.hot, totals.hot_counts, values, owner, context, pair)


BLOCK_TOKENS = 1 << 20
TOP_SCALE = 2000  # numerators are answered in 1 / 2000
HEAD, BLOCK = 0, 1
_NAME_BITS = np.uint64((1 << 48) - 1)
_SALT = np.uint64(0x9FB21C651E98DF25)
SENT = (
    "shard int, slice bigint, kind int, doc_id {kind}, sums binary, cold bigint, names binary, runs binary, "
    "hot_names binary, hot_runs binary, hot_words binary, contexts binary, train binary, rows binary"
)
TOLD = "slice bigint, kind int, doc_id {kind}, sums binary, cold bigint, counts binary, tops binary, rows binary"
SCORED = "doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base bigint, score bigint"


def _names(columns: str) -> list[str]:
    return [column.split()[0] for column in columns.split(", ")]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the greatest needs; the first byte says how many."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _packed_names(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked_names(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _fixed(values: np.ndarray) -> np.ndarray:
    return np.rint(values * UNIT)


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums per text; whole numbers below 2 ** 53, so their order does not matter."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return first, np.diff(np.r_[first, len(values)])


def _block_rows(totals: Totals, pairs: Trie, shards: int, slice_: int, parts: list[tuple], ids: pa.Array) -> pa.RecordBatch:
    """A slice of texts as one head, with the sums of its hot tokens, and a block per shard."""
    word, context, row, train = (np.concatenate(x) for x in zip(*parts, strict=True))
    n_rows = len(ids)
    hot = totals.hot_place(word)
    is_hot = hot >= 0
    counts = totals.hot_counts[hot[is_hot]]
    own = row[is_hot]
    known, base = _sums(own, np.ones(len(own)), n_rows), _sums(own, _fixed(totals.base(counts)), n_rows)
    score = _sums(own, _fixed(-np.log10(counts + totals.prior)), n_rows)
    before = np.r_[totals.hot_place(context[:1]), hot[:-1]]  # each context is the word before
    both = np.flatnonzero(is_hot & (before >= 0))
    at = pairs.find_pairs(hot[both], context[both])
    done = both[at >= 0]
    score += _sums(row[done], _fixed(pairs.pair_table[pairs.pair_code[at[at >= 0]]]), n_rows)
    n_tokens = np.bincount(row, minlength=n_rows)
    sums = np.stack([~train, n_tokens, known, base, score]).astype(np.int64).tobytes()

    left = np.ones(len(word), dtype=bool)
    left[done] = False
    cold, warm = np.flatnonzero(left & ~is_hot), np.flatnonzero(left & is_hot)
    sorted_, cuts = [], []
    for index, name in ((cold, words.mix(word[cold] ^ _SALT)), (warm, words.mix(words.mix(word[warm]) ^ context[warm]))):
        order = np.argsort(name)
        index, name = index[order], name[order]
        shard = (name >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)  # grows with the name
        sorted_.append((index, name))
        cuts.append(np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64)))
    out: list[tuple] = [(slice_ % shards, slice_, HEAD, ids, sums, 0, *(b"",) * 8)]
    none = ids.slice(0, 0)
    short = (words.mix(context) >> np.uint64(32)).astype("<u4")
    for k in range(shards):
        (index, name), (warm_index, warm_name) = ((i[c[k] : c[k + 1]], n[c[k] : c[k + 1]]) for (i, n), c in zip(sorted_, cuts, strict=True))
        if not len(index) and not len(warm_index):
            continue
        every = np.r_[index, warm_index]
        first, runs = _runs(name)
        warm_first, warm_runs = _runs(warm_name)
        out.append(
            (
                k, slice_, BLOCK, none, b"", len(index),
                _packed_names(name[first] & _NAME_BITS), _packed(runs),
                _packed_names(warm_name[warm_first] & _NAME_BITS), _packed(warm_runs), _packed(hot[warm_index[warm_first]]),
                short[index].tobytes(), np.packbits(train[row[every]]).tobytes(), _packed(row[every]),
            )
        )
    columns = list(zip(*out, strict=True))
    offsets = pa.array(np.cumsum([0, *(len(x) for x in columns[3])]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays(columns[3]))
    kinds = (pa.int32(), pa.int64(), pa.int32(), None, pa.binary(), pa.int64(), *(pa.binary(),) * 8)
    arrays = [lists if kind is None else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.record_batch(arrays, names=_names(SENT))


def _send(docs: DataFrame, shared, shards: int, kind: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        pairs = Trie.mapped(totals.pairs)
        slice_ = TaskContext.get().partitionId() << 32
        parts, ids, n_tokens = [], [], 0
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                word, context, row = tokens(part)
                parts.append((word, context, row + sum(map(len, ids)), _training(part)))
                ids.append(part.column("doc_id"))
                n_tokens += len(word)
                if n_tokens >= BLOCK_TOKENS:
                    yield _block_rows(totals, pairs, shards, slice_, parts, pa.concat_arrays(ids))
                    slice_, parts, ids, n_tokens = slice_ + 1, [], [], 0
        if parts:
            yield _block_rows(totals, pairs, shards, slice_, parts, pa.concat_arrays(ids))

    return docs.mapInArrow(pack, SENT.format(kind=f"array<{kind}>"))


def _answer(blocks: list[dict], totals: Totals) -> Iterator[pa.RecordBatch]:
    """Counts of words and numerators of pairs for all tokens sent to a shard."""
    names = [_unpacked_names(b["names"]) for b in blocks]
    vocabulary = np.unique(np.concatenate(names))
    word = np.concatenate([np.repeat(np.searchsorted(vocabulary, n), _unpacked(b["runs"])) for n, b in zip(names, blocks, strict=True)])
    context = np.concatenate([np.frombuffer(b["contexts"], dtype="<u4") for b in blocks]).astype(np.int64)
    n_cold = [b["cold"] for b in blocks]
    rows = [b["rows"] for b in blocks]
    train = [np.unpackbits(np.frombuffer(b["train"], dtype=np.uint8), count=(len(r) - 1) // r[0]).astype(bool) for b, r in zip(blocks, rows, strict=True)]
    learned = np.concatenate([t[:n] for t, n in zip(train, n_cold, strict=True)])
    counts = np.bincount(word[learned], minlength=len(vocabulary))
    code, where = np.unique(word << 32 | context, return_inverse=True)
    seen = np.bincount(where[learned], minlength=len(code))
    owner, before = code >> 32, (code & 0xFFFFFFFF).astype(np.uint64)
    values = totals.unigram(counts)
    inside = np.flatnonzero(counts > 0)
    place = np.full(len(vocabulary), -1)
    place[inside] = np.arange(len(inside))
    pair = seen > 0
    numerators = np.log10(seen[pair] + totals.prior * 10 ** values[owner[pair]])
    trie = Trie.mapped(Trie.build(vocabulary[inside], counts[inside], values[inside], place[owner[pair]], before[pair], numerators))
    at_word = trie.find_words(vocabulary)
    unigram = np.full(len(vocabulary), math.log10(totals.unknown))
    unigram[at_word >= 0] = trie.word_table[trie.word_code[at_word[at_word >= 0]]]
    count = np.zeros(len(vocabulary), dtype=np.int64)
    count[at_word >= 0] = trie.counts[at_word[at_word >= 0]]
    at_pair = trie.find_pairs(at_word[owner], before)
    top = math.log10(totals.prior) + unigram[owner]
    top[at_pair >= 0] = trie.pair_table[trie.pair_code[at_pair[at_pair >= 0]]]
    top, count = top[where], count[word]

    # pairs of a hot word and a rarer context: known by the pair, the word's count is everywhere
    warm_names = [_unpacked_names(b["hot_names"]) for b in blocks]
    warm_runs = [_unpacked(b["hot_runs"]) for b in blocks]
    warm = np.unique(np.concatenate(warm_names))
    each = np.concatenate([np.repeat(np.searchsorted(warm, n), r) for n, r in zip(warm_names, warm_runs, strict=True)])
    learned = np.concatenate([t[n:] for t, n in zip(train, n_cold, strict=True)])
    seen = np.bincount(each[learned], minlength=len(warm))
    hot_word = np.zeros(len(warm), dtype=np.int64)
    for n, b in zip(warm_names, blocks, strict=True):
        hot_word[np.searchsorted(warm, n)] = _unpacked(b["hot_words"])
    used, place = np.unique(hot_word, return_inverse=True)
    counts = totals.hot_counts[used]
    values = totals.unigram(counts)
    order = np.lexsort((warm, place))  # a pair's own name stands for its context
    order = order[seen[order] > 0]
    numerators = np.log10(seen[order] + totals.prior * 10 ** values[place[order]])
    trie = Trie.mapped(Trie.build(totals.hot[used], counts, values, place[order], warm[order], numerators))
    at_pair = trie.find_pairs(place, warm)
    warm_top = math.log10(totals.prior) + trie.word_table[trie.word_code[place]]
    warm_top[at_pair >= 0] = trie.pair_table[trie.pair_code[at_pair[at_pair >= 0]]]
    warm_top = warm_top[each]

    first = warm_first = 0
    for block, n, row in zip(blocks, n_cold, rows, strict=True):
        n_warm = (len(row) - 1) // row[0] - n
        tops = np.r_[top[first : first + n], warm_top[warm_first : warm_first + n_warm]]
        told = (_packed(count[first : first + n]), np.rint(tops * TOP_SCALE).astype("<i2").tobytes(), row)
        first, warm_first = first + n, warm_first + n_warm
        arrays = [pa.array([block["slice"]]), pa.array([BLOCK], pa.int32()), block["doc_id"], pa.array([b""], pa.binary()), pa.array([n])]
        yield pa.record_batch([*arrays, *(pa.array([x], pa.binary()) for x in told)], names=_names(TOLD))


def _ask(sent: DataFrame, shared, shards: int, kind: str) -> DataFrame:
    """Every shard's answers, and the heads as they are. A task holds the blocks of one shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for at, (own, row_kind) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if held and own != shard:
                    yield from _answer(held, shared.value)
                    held = []
                shard = own
                row = batch.slice(at, 1)
                if row_kind == HEAD:
                    empty = pa.array([b""], pa.binary())
                    yield pa.record_batch([*(row.column(n) for n in _names(TOLD)[:5]), empty, empty, empty], names=_names(TOLD))
                else:
                    block = {name: row.column(name)[0].as_py() for name in _names(SENT) if name != "doc_id"}
                    held.append(block | {"doc_id": row.column("doc_id")})
        if held:
            yield from _answer(held, shared.value)

    dealt = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return dealt.mapInArrow(ask, TOLD.format(kind=f"array<{kind}>"))


def _sum_up(told: DataFrame, shared, kind: str) -> DataFrame:
    """The texts of each slice: the head's sums and those of the answers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        ids, sums = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([ids, pa.array(sums[0] > 0), *(pa.array(x) for x in sums[1:])], names=_names(SCORED))

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in ("kind", "sums", "cold", "counts", "tops", "rows")}
                if row["kind"].as_py() == HEAD:
                    if ids is not None:
                        yield out()
                    ids = batch.column("doc_id").slice(at, 1).flatten()
                    sums = np.frombuffer(row["sums"].as_py(), dtype=np.int64).reshape(5, -1).copy()
                    continue
                n, cold = len(ids), row["cold"].as_py()
                rows, counts = _unpacked(row["rows"].as_py()), _unpacked(row["counts"].as_py())
                own = rows[:cold]
                sums[2] += _sums(own, counts > 0, n)
                sums[3] += _sums(own, _fixed(totals.base(counts)), n)
                sums[4] += _sums(own, _fixed(-np.log10(counts + totals.prior)), n)
                tops = np.frombuffer(row["tops"].as_py(), dtype="<i2").astype(np.float64)
                sums[4] += _sums(rows, tops * (UNIT / TOP_SCALE), n)
        if ids is not None:
            yield out()

    met = told.repartition("slice").sortWithinPartitions("slice", "kind")  # the head comes first
    return met.mapInArrow(add, SCORED.format(kind=kind))


def lm_scores(docs: DataFrame, prior: float = PRIOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    Learns from documents whose crc32 of the id modulo 5 is not 1 and scores
    all. ``base_score`` is the add-a-half unigram's log10 probability, ``score`` the
    trie's. A null or empty text is its end token alone. A null id counts as fold
    0 and is learned from. Repeated rows are texts of their own. Without any
    training text every score is 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    n_bytes = text_bytes(rows)
    shards = max(1, math.ceil(n_bytes / shard_bytes))
    totals = _totals(rows, shards, n_bytes)
    totals.prior = prior
    totals.pairs = _hot_pairs(rows, totals)
    shared = docs.sparkSession.sparkContext.broadcast(totals)  # at most HOT_WORDS words and HOT_PAIRS pairs
    told = _ask(_send(rows, shared, shards, kind), shared, shards, kind)
    return _sum_up(told, shared, kind).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(totals.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") / UNIT).alias("base_score"),
        (F.col("score") / UNIT).alias("score"),
    )
