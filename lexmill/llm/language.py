"""Language of whole texts by multilingual mixture inference.

A language is a distribution over hashed byte trigrams. A text is a mixture:
expectation-maximisation finds its language proportions from the likelihoods of
its words, a word's being that of its trigrams. The language set is selected by
penalised likelihood: languages join in the order of their proportion while the
gain in log likelihood is above ``PENALTY`` times the logarithm of the words.

There may be any number of languages. Their likelihoods are dealt to blocks of
``LANGUAGE_BLOCK``, of which a task holds one at a time. A first pass over the
blocks finds each text's best single language and settles the texts for which no
mixture can win; a second one lets the other texts' ``LANGUAGE_BLOCK`` languages of
the greatest proportion meet the next block's, so a mixture has at most that many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import words
from lexmill.llm.common import fold_array, fold_of, kept, opened

BINS = 1 << 16
LANGUAGE_BLOCK = 128  # likelihoods of 32 MB
NUMBERS_AT_ONCE = 1 << 24  # likelihoods of trigrams or words, 64 MB
CODES_AT_ONCE = 1 << 22  # (language, bin) counts in a task before they are passed on
SMOOTHING = 0.5
TEMPER = 0.5  # neighbouring trigrams share letters
ROUNDS, LATER_ROUNDS = 10, 10
PENALTY = 3.0
HELD_OUT_FOLD = 0
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

_BLANK = 0x20
_LETTERS = np.full(256, _BLANK, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin per trigram, first trigram of each word, first word of each text)``.

    A trigram stands for its middle byte; blanks are around each word, and bytes
    of ASCII that are no letters count as blank.
    """
    data, offsets = words.text_buffer(texts)
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, _BLANK, dtype=np.uint8)
    inner = np.ones(len(padded), dtype=bool)
    inner[offsets + np.arange(n + 1)] = False  # a blank before each text and at the end
    padded[inner] = _LETTERS[data]
    full = padded != _BLANK
    middle = np.flatnonzero(full)
    code = padded[middle - 1].astype(np.uint32) << np.uint32(16) | padded[middle].astype(np.uint32) << np.uint32(8) | padded[middle + 1]
    bins = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    begins = full[middle] & ~full[middle - 1]
    first = np.flatnonzero(begins)
    return bins.astype(np.int64), first, np.searchsorted(middle[first], offsets + np.arange(n + 1))


def _table(counts: np.ndarray) -> np.ndarray:
    """Log probabilities (bin, language) from counts (language, bin)."""
    total = counts.sum(axis=1, keepdims=True) + SMOOTHING * BINS
    return np.ascontiguousarray(np.log((counts + SMOOTHING) / total).T * TEMPER).astype(np.float32)


def _likely(table: np.ndarray, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language of the table, some trigrams at a time."""
    out = np.zeros((len(first), table.shape[1]), dtype=np.float32)
    step = max(1, NUMBERS_AT_ONCE // table.shape[1])
    for a in range(0, len(bins), step):
        low = int(np.searchsorted(first, a, side="right")) - 1  # the word that trigram a belongs to
        high = int(np.searchsorted(first, a + step))
        begins = np.maximum(first[low:high] - a, 0)
        out[low:high] += np.add.reduceat(table[bins[a : a + step]], begins, axis=0)
    return out


@dataclass
class Languages:
    names: list[str]
    blocks: list  # tables of LANGUAGE_BLOCK languages each, as arrays or broadcast

    @classmethod
    def build(cls, names: list[str], counts: np.ndarray, block: int = LANGUAGE_BLOCK) -> Languages:
        return cls(names, [_table(counts[a : a + block]) for a in range(0, len(names), block)])

    def tables(self) -> Iterator[tuple[int, np.ndarray]]:
        """``(number of its first language, table)``, block after block."""
        first = 0
        for block in self.blocks:
            with opened(block, keep=len(self.blocks) == 1) as table:
                yield first, table
                first += table.shape[1]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(language number, proportion)`` of each text; -1 for texts without words."""
        bins, first, bounds = trigrams(texts)
        n = len(bounds) - 1
        best, score = np.full(n, -1), np.zeros(n)
        if not len(first):
            return best, score
        rows = np.flatnonzero(np.diff(bounds))
        sizes = np.diff(bounds)[rows]
        if len(self.blocks) == 1:
            ((_, table),) = self.tables()
            best[rows], score[rows] = _mixtures(_likely(table, bins, first), sizes)
            return best, score
        best[rows], gain = self._singles(bins, first, sizes)
        score[rows] = 1
        open_ = np.flatnonzero(gain > PENALTY * np.log(sizes + 1))
        begins, ends = np.cumsum(sizes) - sizes, np.r_[first[1:], len(bins)]
        for some in _groups(open_, sizes, NUMBERS_AT_ONCE // (2 * LANGUAGE_BLOCK)):
            word = _ranges(begins[some], sizes[some])
            length = ends[word] - first[word]
            at = rows[some]
            best[at], score[at] = self._pooled(bins[_ranges(first[word], length)], np.cumsum(length) - length, sizes[some], best[at])
        return best, score

    def _singles(self, bins: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's best single language, and what a mixture could gain over it at most."""
        begins, row = np.cumsum(sizes) - sizes, np.arange(len(sizes))
        single, value = np.zeros(len(sizes), dtype=np.int64), np.full(len(sizes), -np.inf)
        top = np.full(len(first), -np.inf, dtype=np.float32)
        for start, table in self.tables():
            likely = _likely(table, bins, first)
            alone = np.add.reduceat(likely.astype(np.float64), begins, axis=0)
            lead = alone.argmax(axis=1)
            better = alone[row, lead] > value
            single[better], value[better] = start + lead[better], alone[row, lead][better]
            np.maximum(top, likely.max(axis=1), out=top)
        return single, np.add.reduceat(top.astype(np.float64), begins) - value

    def _pooled(self, bins: np.ndarray, first: np.ndarray, sizes: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixtures over the languages that stay in a text's pool after all blocks; its best single one does."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        pool = np.zeros((len(first), 0), dtype=np.float32)
        number = np.zeros((len(sizes), 0), dtype=np.int64)
        for start, table in self.tables():
            new = np.arange(start, start + table.shape[1])
            pool = np.hstack([pool, _likely(table, bins, first)])
            number = np.hstack([number, np.broadcast_to(new, (len(sizes), len(new)))])
            if number.shape[1] <= LANGUAGE_BLOCK:
                continue
            weight = np.exp(pool - pool.max(axis=1, keepdims=True))
            shares, _ = _expectation(weight, row, sizes, np.full(number.shape, 1 / number.shape[1]), ROUNDS)
            shares[number == single[:, None]] += 1
            stay = np.sort(np.argsort(-shares, axis=1, kind="stable")[:, :LANGUAGE_BLOCK], axis=1)
            pool, number = np.take_along_axis(pool, stay[row], axis=1), np.take_along_axis(number, stay, axis=1)
        column, share = _mixtures(pool, sizes)
        return number[np.arange(len(sizes)), column], share


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _groups(texts: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``texts`` in runs of at most ``most`` words, or a single text that has more."""
    ends = np.cumsum(sizes[texts])
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts[first:last]
        first = last


def _mixtures(likely: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(column, share)`` of the language with the greatest share in each text; ``likely`` has a row per word."""
    n_lang = likely.shape[1]
    begins = np.cumsum(sizes) - sizes
    alone = np.add.reduceat(likely.astype(np.float64), begins, axis=0)
    single = alone.argmax(axis=1)
    shares = np.zeros((len(sizes), n_lang))
    shares[np.arange(len(sizes)), single] = 1
    if n_lang == 1:
        return single, np.ones(len(sizes))
    price = PENALTY * np.log(sizes + 1)
    top = likely.max(axis=1)
    # no mixture is above the sum of each word's best language
    gain = np.add.reduceat(top.astype(np.float64), begins) - alone.max(axis=1)
    open_ = np.flatnonzero(gain > price)
    if len(open_):
        shares[open_] = _select(likely, top, begins[open_], sizes[open_], alone[open_], price[open_])
    best = shares.argmax(axis=1)
    return best, shares[np.arange(len(sizes)), best]


def _select(likely, top, begins, sizes, alone, price) -> np.ndarray:
    """Shares of each text's selected languages."""
    at = _ranges(begins, sizes)
    weight = np.exp(likely[at] - top[at, None])
    row = np.repeat(np.arange(len(sizes)), sizes)
    base = np.add.reduceat(top[at].astype(np.float64), np.cumsum(sizes) - sizes)
    n_lang = likely.shape[1]
    full, reach = _expectation(weight, row, sizes, np.full((len(sizes), n_lang), 1 / n_lang), ROUNDS)
    single = alone.argmax(axis=1)
    shares = np.zeros_like(full)
    shares[np.arange(len(sizes)), single] = 1
    value = alone.max(axis=1)
    order = np.argsort(-full, axis=1, kind="stable")
    live = np.flatnonzero(base + reach > value + price)
    for k in range(2, n_lang + 1):
        if not len(live):
            break
        allowed = np.zeros((len(live), n_lang))
        np.put_along_axis(allowed, order[live, :k], 1 / k, axis=1)
        pick = np.isin(row, live)
        renumber = np.searchsorted(live, row[pick])
        found, fit = _expectation(weight[pick], renumber, sizes[live], allowed, LATER_ROUNDS)
        better = base[live] + fit - price[live] * (k - 1) > value[live]
        shares[live[better]] = found[better]
        value[live[better]] = (base[live] + fit - price[live] * (k - 1))[better]
        live = live[better]
    return shares


def _expectation(weight, row, sizes, shares, rounds) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` of expectation-maximisation, and each text's log likelihood."""
    begins = np.cumsum(sizes) - sizes
    for _ in range(rounds):
        joint = weight * shares[row].astype(np.float32)
        total = joint.sum(axis=1)
        joint /= np.maximum(total, 1e-30)[:, None]
        shares = np.add.reduceat(joint, begins, axis=0).astype(np.float64) / sizes[:, None]
    total = (weight * shares[row].astype(np.float32)).sum(axis=1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-30)).astype(np.float64), begins)


def learn(docs: DataFrame, held_out: int = HELD_OUT_FOLD) -> Languages:
    """The languages of all labelled documents outside the held-out fold, their tables broadcast.

    Counts are summed in the tasks and by (language, bin). The names of the languages
    reach the driver, and a row per bin of one block's languages at a time.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(F.coalesce(fold_of(F.col("doc_id")), F.lit(1)) != held_out)
    names = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not names:
        return Languages([], [])
    number = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
                held.append(_coded(*trigrams(part.column("text")), lang))
                waiting += len(held[-1][0])
                if waiting > CODES_AT_ONCE:
                    held = [_summed(held)]
                    waiting = len(held[0][0])
                    if waiting > CODES_AT_ONCE // 2:
                        yield _counted(held.pop())
                        waiting = 0
        if held:
            yield _counted(_summed(held))

    rows = labelled.select("lang", "text").mapInArrow(count, "lang bigint, bin bigint, n bigint")
    summed = kept(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    blocks = []
    for first in range(0, len(names), LANGUAGE_BLOCK):
        counts = np.zeros((min(LANGUAGE_BLOCK, len(names) - first), BINS))
        own = summed.where(F.col("lang").between(first, first + len(counts) - 1))
        for batch in own.toArrow().to_batches():  # at most LANGUAGE_BLOCK x BINS rows
            counts[np.asarray(batch.column("lang")) - first, np.asarray(batch.column("bin"))] = np.asarray(batch.column("n"))
        blocks.append(spark.sparkContext.broadcast(_table(counts)))
    return Languages(names, blocks)


def _coded(bins: np.ndarray, first: np.ndarray, bounds: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(language * BINS + bin, count)`` of a slice, sorted."""
    some, lang = np.unique(lang, return_inverse=True)
    per_word = np.diff(np.r_[first, len(bins)])
    code = np.repeat(np.repeat(lang, np.diff(bounds)), per_word) * BINS + bins
    if len(some) * BINS <= 4 * len(code):  # then counting is cheaper than sorting
        n = np.bincount(code, minlength=len(some) * BINS)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(code, return_counts=True)
    return some[code // BINS] * BINS + code % BINS, n


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, first = np.unique(code[order], return_index=True)
    return code, np.add.reduceat(n[order], first) if len(code) else n


def _counted(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    code, n = part
    return pa.record_batch([pa.array(code // BINS), pa.array(code % BINS), pa.array(n)], names=["lang", "bin", "n"])


def predict_languages(docs: DataFrame, held_out: int = HELD_OUT_FOLD) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document.

    Learned from ``text`` and ``lang`` of the documents whose crc32 of the id modulo
    5 is not ``held_out``; a prediction sees the text only. ``score`` is the share of
    the predicted language. ``und`` with score 0 for a null text, one without a
    letter, or if there was nothing to learn from. A null id is in no held-out
    fold. Repeated rows are predicted each; a null ``lang`` is not learned from.
    Any number of languages; a task holds the likelihoods of one block of them.
    """
    model = learn(docs, held_out)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.names, UNKNOWN], dtype=object)
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column("text"), "")
                lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                if model.names:
                    best, score = model.predict(texts)
                else:
                    best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                best = np.where(lettered, best, -1)
                score = np.where(best < 0, 0.0, np.clip(score, 0, 1))
                # a null id counts as learned from
                fold = np.array([i is not None for i in part.column("doc_id").to_pylist()]) & (fold_array(part.column("doc_id")) == held_out)
                yield pa.record_batch([part.column("doc_id"), pa.array(fold), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
