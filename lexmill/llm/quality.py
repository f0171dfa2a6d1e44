"""Quality classifier without labels: a weak-label model trains a hashed linear scorer.

Heuristic labellers vote good, bad or not at all on cheap properties of a text.
Expectation-maximisation over the counts of all vote patterns estimates each
labeller's accuracy in both classes and the share of bad texts. The posterior of
a bounded sample's patterns then trains a linear scorer on hashed word shapes,
which scores every text: it learns what the labellers agree on and also judges
texts on which they are silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import words
from lexmill.llm.common import unused

BUCKETS = 1 << 14
SAMPLE = 20_000  # documents the scorer is fitted on
STEPS, RATE, DECAY = 200, 0.5, 1e-4
EM_ROUNDS = 100
REJECT_ABOVE = 0.5
SLICE_BYTES = 2 << 20
SILENT, GOOD, BAD = 0, 1, 2

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, dtype=bool)  # punctuation of ordinary sentences
_PLAIN[[ord(c) for c in ".,;:'\"()?-"]] = True
_SIGN = ~(_LETTER | _DIGIT | _PLAIN)
SHAPES = 3 * 4 * 3 * 4 * 2


@dataclass
class Measures:
    """Per text, from one pass over its bytes."""

    n_words: np.ndarray
    sign_share: np.ndarray  # of bytes in words
    upper_share: np.ndarray  # of ASCII and other letter bytes
    echo_share: np.ndarray  # words equal to the one before
    new_share: np.ndarray  # distinct words
    bare_share: np.ndarray  # words without letter or digit
    mean_length: np.ndarray
    stop_share: np.ndarray  # words that end a sentence
    tail_share: np.ndarray  # words that end in a sign
    shapes: np.ndarray  # of all words, end to end
    bounds: np.ndarray


def measure(texts: pa.Array) -> Measures:
    found = words.find_words(texts)
    n = found.counts
    row = found.rows()
    size = found.ends - found.starts
    hashes = words.word_hashes(found)
    echo = np.zeros(len(row), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])

    def per_word(kind: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(kind[found.data], dtype=np.int64)]
        return total[found.ends] - total[found.starts]

    upper, letter, digit, sign = (per_word(kind) for kind in (_UPPER, _LETTER, _DIGIT, _SIGN))

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=len(n))

    some = np.maximum(n, 1)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(found.bounds.tolist(), found.bounds[1:].tolist(), strict=False)], dtype=np.int64)
    last = found.data[found.ends - 1] if len(size) else found.data[:0]
    case = np.where(upper == 0, 0, np.where((upper > 1) & (upper == letter), 2, 1))
    signs = np.where(sign == 0, 0, np.where(sign == size, 3, np.minimum(sign, 2)))
    digits = np.where(digit == 0, 0, np.where(digit == size, 2, 1))
    lengths = np.digitize(size, (3, 8, 15))
    shapes = (((case * 4 + signs) * 3 + digits) * 4 + lengths) * 2 + echo
    return Measures(
        n,
        per_text(sign) / np.maximum(per_text(size), 1),
        per_text(upper) / np.maximum(per_text(letter), 1),
        per_text(echo) / some,
        distinct / some,
        per_text((letter + digit) == 0) / some,
        per_text(size) / some,
        per_text(last == ord(".")) / some,
        per_text(_SIGN[last] & (letter > 0)) / some,
        shapes,
        found.bounds,
    )


def _vote(bad: np.ndarray, good: np.ndarray, asked: np.ndarray | bool = True) -> np.ndarray:
    return np.where(asked & bad, BAD, np.where(asked & good, GOOD, SILENT))


def votes(m: Measures) -> np.ndarray:
    """``(texts, labellers)``. Texts without words get no vote."""
    some, many = m.n_words >= 5, m.n_words >= 50
    columns = (
        _vote(m.sign_share > 0.08, m.sign_share < 0.02, some),
        _vote(m.upper_share > 0.4, m.upper_share < 0.1, some),
        _vote(m.echo_share > 0.15, m.echo_share < 0.05, m.n_words >= 8),
        _vote(m.new_share < 0.35, m.new_share > 0.55, many),
        _vote(m.bare_share > 0.1, m.bare_share < 0.01, some),
        _vote((m.mean_length > 12) | (m.mean_length < 2), (m.mean_length > 3) & (m.mean_length < 8), some),
        _vote(m.stop_share < 0.005, (m.stop_share > 0.03) & (m.stop_share < 0.35), many),
        _vote(m.tail_share > 0.2, m.tail_share < 0.05, some),
    )
    return np.stack(columns, axis=1)


LABELLERS = 8


def patterns(m: Measures) -> np.ndarray:
    """All votes on a text as one number."""
    return votes(m) @ (3 ** np.arange(LABELLERS))


def weak_labels(counts: dict[int, int]) -> dict[int, float]:
    """Posterior of "bad" for each vote pattern, from how often each occurs.

    A silent labeller says nothing about the class. Each looks for a failure of
    its own, so it starts from "bad" wherever any finds one; a labeller is taken
    to say "bad" more often of bad texts than of good ones.
    """
    known = np.array(sorted(counts), dtype=np.int64)
    if not len(known):
        return {}
    n = np.array([counts[k] for k in known.tolist()], dtype=np.float64)
    cast = known[:, None] // 3 ** np.arange(LABELLERS) % 3
    is_bad, is_good = cast == BAD, cast == GOOD
    posterior = np.where(is_bad.any(axis=1), 0.9, 0.05)
    for _ in range(EM_ROUNDS):
        share = np.clip((n @ posterior + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)
        says_bad = []
        for weight, prior in ((posterior, (2, 1)), (1 - posterior, (1, 2))):
            of = (n * weight) @ (is_bad | is_good)
            says_bad.append(((n * weight) @ is_bad + prior[0]) / (of + sum(prior)))
        in_good = says_bad[1]
        in_bad = np.maximum(says_bad[0], in_good)
        log_odds = np.log(share / (1 - share)) + is_bad @ np.log(in_bad / in_good) + is_good @ np.log((1 - in_bad) / (1 - in_good))
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
    return dict(zip(known.tolist(), posterior.tolist(), strict=True))


def features(m: Measures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features ``(bucket, value, bounds)``: square roots of the shares of word shapes, shape pairs and measures."""
    n = len(m.n_words)
    row = np.repeat(np.arange(n), np.diff(m.bounds))
    shape = m.shapes.astype(np.int64)
    pair = shape[1:] * SHAPES + shape[:-1] + SHAPES
    inner = row[1:] == row[:-1]
    steps = np.digitize(m.new_share, np.arange(0.1, 1.0, 0.1)) + 10 * (m.n_words >= 50)
    whole = np.flatnonzero(m.n_words > 0)
    name = np.concatenate([shape, pair[inner], SHAPES * (SHAPES + 1) + steps[whole]])
    owner = np.concatenate([row, row[1:][inner], whole])
    scale = np.concatenate([1 / np.maximum(m.n_words, 1)[row], 1 / np.maximum(m.n_words - 1, 1)[row[1:][inner]], np.ones(len(whole))])
    bucket = (words.mix(name.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    key, where = np.unique(owner * BUCKETS + bucket, return_inverse=True)
    value = np.sqrt(np.bincount(where, weights=scale, minlength=len(key)))
    owner, bucket = np.divmod(key, BUCKETS)
    return bucket, value, np.searchsorted(owner, np.arange(n + 1))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    weak: dict[int, float]

    def bad(self, m: Measures) -> np.ndarray:
        """Probability of "bad"; 0 for texts without words, on which nothing is known."""
        bucket, value, bounds = features(m)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        odds = np.bincount(row, weights=value * self.weights[bucket], minlength=len(bounds) - 1) + self.bias
        return np.where(m.n_words > 0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0.0)


def fit_scorer(bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray, target: np.ndarray, weak: dict[int, float]) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps over the whole sample."""
    n = len(target)
    row = np.repeat(np.arange(n), np.diff(bounds))
    weights, bias = np.zeros(BUCKETS), 0.0
    past, past_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS if n else 0):
        odds = np.bincount(row, weights=value * weights[bucket], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - target) / n
        slope = np.bincount(bucket, weights=value * error[row], minlength=BUCKETS) + DECAY / n * weights
        past += slope**2
        past_bias += error.sum() ** 2
        weights -= RATE * slope / np.sqrt(past)
        bias -= RATE * error.sum() / np.sqrt(past_bias)
    return Scorer(weights, bias, weak)


def train(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Weak labels from the vote patterns of all documents, a scorer from ``sample`` distinct texts, the least by a hash of the text.

    Copies count as one text, so that a large group of them does not fill the sample.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                yield pa.record_batch([part.column("place"), pa.array(patterns(measure(part.column("text"))))], names=["place", "pattern"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                m = measure(part.column("text"))
                bucket, value, bounds = features(m)
                packed = [(bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch(
                    [part.column("place"), pa.array(patterns(m)), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))],
                    names=["place", "pattern", "bucket", "value"],
                )

    placed = docs.select(F.xxhash64("text").alias("place"), "text")
    voted = placed.mapInArrow(vote, "place bigint, pattern bigint")
    votes = voted.groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("texts")).collect()  # at most 3 ** LABELLERS rows
    weak = weak_labels({r["pattern"]: r["n"] for r in votes})
    total = sum(r["texts"] for r in votes)  # copies have one pattern
    # about twice the sample by the hash, then its least, so that texts are not sorted as a whole
    share = min(1.0, 2 * sample / max(total, 1))
    drawn = placed.where(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)) + 1) if share < 1 else placed
    rows = drawn.mapInArrow(describe, "place bigint, pattern bigint, bucket binary, value binary").dropDuplicates(["place"])
    rows = rows.orderBy(F.xxhash64("place"), "place").limit(sample).collect()  # ``sample`` rows
    bucket = [np.frombuffer(r["bucket"], dtype=np.int32) for r in rows]
    value = [np.frombuffer(r["value"], dtype=np.float32) for r in rows]
    bounds = np.r_[0, np.cumsum([len(b) for b in bucket])].astype(np.int64)
    target = np.array([weak[r["pattern"]] for r in rows])
    joined = (np.concatenate(x) if x else np.zeros(0) for x in (bucket, value))
    return fit_scorer(*(x.astype(kind) for x, kind in zip(joined, (np.int64, np.float64), strict=True)), bounds, target, weak)


def with_quality(docs: DataFrame, scorer: Scorer, names: tuple[str, str] = ("bad_score", "weak_score")) -> DataFrame:
    """``docs`` with all their columns, the scorer's probability of "bad" and that of the labellers."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS numbers
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.DoubleType()) for name in names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            batch = pa.record_batch(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for part in words.slices(batch, str(place), SLICE_BYTES):
                m = measure(part.column(place))
                weak = [own.weak.get(k, 0.5) for k in patterns(m).tolist()]
                yield pa.record_batch([*part.columns, pa.array(own.bad(m)), pa.array(weak, pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)


def quality_scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, bad_score, weak_score, accepted)`` of every document.

    Null and empty texts have no words, score 0 and are accepted: nothing speaks
    against them. Repeated rows are scored each. With no documents nothing is learned.
    """
    rows = docs.select("doc_id", "text")
    return with_quality(rows, train(rows)).select("doc_id", "bad_score", "weak_score", (F.col("bad_score") <= REJECT_ABOVE).alias("accepted"))


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents; all columns stay."""
    names = tuple(unused(docs, "_bad", "_weak"))
    scored = with_quality(docs, train(docs.select("text")), names)
    return scored.where(F.col(names[0]) <= REJECT_ABOVE).drop(*names)
