"""Every operator of the subpackage against a plain version of it, and on odd tables."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from plain import brute_components, brute_removal, brute_targets, grams, plain_language, some_letters, some_text, tokens
from pyspark.sql import functions as F

from lexmill.llm import chat_format, decontaminate, gif, jaccard_join, language, lm_scores, mixing, quality, substring_dedup, token_counts
from lexmill.llm.common import fold_of
from lexmill.llm.components import components
from lexmill.llm.fm_index import FMIndex
from lexmill.llm.lm_trie import EliasFano, Trie
from lexmill.llm.queries import OP9_SQL
from lexmill.llm.signature_tree import Tree, linked

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, odd texts and ids."""
    rng = random.Random(5)
    texts = [some_text(rng, rng.choice((6, 40, 90, 200))) for _ in range(60)]
    base = some_text(rng, 150)
    near = []
    for _ in range(30):
        words = base.split(" ")
        for _ in range(rng.choice((0, 1, 1, 2, 9))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        near.append(" ".join(words))
    passage = some_text(rng, 60)
    shared = [f"{some_text(rng, 80)}\n{passage}\t{some_text(rng, 50)}" for _ in range(20)]
    odd = [None, "", "  \n", "a", "a b", "A  b", "a b c d", "!!!", "　", "é É", "x " * 500, "one two " * 300, "longword" * 4000, some_text(rng, 9000)]
    every = [*texts, *near, *shared, *odd]
    rng.shuffle(every)
    out = [(i, text, ("en", "fr", None)[i % 3], (f"s{i % 4}" if i % 4 else "big"), 0) for i, text in enumerate(every)]
    return [*out, out[3], out[3], (None, texts[0], "en", None, 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "n_chars", "lang", "source")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ("_doc", "_key", "_hash", "_spans", "_place", "_one", "_matches", "_bad", "_weak", "size", "shard", "component", "class", "weight", "anchor")


def clashing(df):
    return df.withColumns({name: F.lit(7) for name in CLASHES})


# --- 1 ------------------------------------------------------------------------------


def test_chat_reads_back_what_was_said(spark):
    rng = random.Random(1)
    pieces = ["<turn>", "</turn>\n", "<text>", "\\", "<", ">", "é", "\n", "user", "\\<", ""]
    said = {}
    for conv in range(40):
        roles = rng.choices(["user", "assistant", "system", "tool", "<turn>x\\"], k=rng.randrange(1, 9))
        said[conv] = [(role, "".join(rng.choices(pieces, k=rng.randrange(6)))) for role in roles]
    said[40] = [("user", "q"), ("assistant", None), ("user", "q" * 100_000), ("assistant", "ok")]
    rows = [(conv, i, role, text) for conv, turns in said.items() for i, (role, text) in enumerate(turns)]
    df = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7))
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chat(df)).collect()}
    assert set(got) == set(said)
    for conv, turns in said.items():
        whole = "".join(f"{role}\n{text or ''}\n" for role, text in turns)
        loss = "".join(text or "" for role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[40].valid


def test_chat_turn_order_and_odd_rows(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"),
            (None, 0, None, None), (4, 0, "user", "u"), (4, 0, "user", "u"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    segments = chat_format.format_chat(df)
    assert {r.conv_id: r.valid for r in chat_format.chat_digests(segments).collect()} == {1: True, 2: False, 3: False, None: False, 4: False}
    assert [r.problem for r in segments.where("conv_id = 4 and segment = 0").orderBy("turn_no").collect()] == [None, "'user' after user", None]
    assert chat_format.chat_digests(chat_format.format_chat(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.Template(open="[turn>")


def test_chat_reader_takes_any_pieces():
    template = chat_format.Template()
    text = template.open + "user" + template.body + template.guarded("a<b\\c</turn>") + template.close
    whole, parts = chat_format.Reader(template), chat_format.Reader(template)
    whole.feed(text, False)
    for char in text:
        parts.feed(char, False)
    assert whole.turns.hexdigest() == parts.turns.hexdigest() == hashlib.sha256(b"user\na<b\\c</turn>\n").hexdigest()


def test_chat_reader_is_linear_in_escapes():
    template = chat_format.Template()
    took = []
    for n in (100_000, 1_000_000):
        reader, said = chat_format.Reader(template), "\\<" * (n // 2)
        began = time.perf_counter()
        reader.feed(template.open + "assistant" + template.body, False)
        reader.feed(template.guarded(said), True)
        took.append(time.perf_counter() - began)
        assert reader.loss_chars == n and reader.loss.hexdigest() == hashlib.sha256(said.encode()).hexdigest()
    assert took[1] < 40 * took[0]


# --- 2 ------------------------------------------------------------------------------


def test_weak_labels_find_accuracies():
    rng = np.random.default_rng(0)
    counts = Counter()
    bad = rng.random(20_000) < 0.2
    for is_bad in bad:
        right = rng.random(quality.LABELLERS) < (0.7 if is_bad else 0.97)
        silent = rng.random(quality.LABELLERS) < 0.2
        says = np.where(silent, 0, np.where(right == is_bad, quality.BAD, quality.GOOD))
        counts[int(says @ (3 ** np.arange(quality.LABELLERS)))] += 1
    weak = quality.weak_labels(counts)
    share = sum(weak[k] * n for k, n in counts.items()) / len(bad)
    assert abs(share - 0.2) < 0.03
    assert quality.weak_labels({}) == {}


def test_quality_keeps_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = quality.quality_scores(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in told}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_quality_on_odd_rows(docs, empty, rows):
    out = quality.quality_scores(docs).collect()
    assert len(out) == len(rows) and all(r.bad_score is not None for r in out)
    stays = quality.accepted(clashing(docs))
    assert stays.columns == [*docs.columns, *CLASHES]
    assert {None, ""} <= {r.text for r in stays.collect()}
    assert quality.accepted(empty).count() == 0


def test_quality_sample_is_of_distinct_texts(spark, monkeypatch):
    rng = random.Random(12)
    texts = [some_text(rng, 30 + n) for n in range(61)]
    drawn = []
    monkeypatch.setattr(
        quality, "fit_scorer", lambda bucket, value, bounds, target, weak: drawn.append(Counter((bucket[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])))
    )
    for copies in (0, 300):
        quality.train(spark.createDataFrame([(text,) for text in [*texts, *texts[:1] * copies]], "text string").repartition(4), sample=61)
    assert drawn[0] == drawn[1] and drawn[1].total() == 61


# --- 3 ------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_containment_equals_brute_force(spark, docs, rows, block):
    rng = random.Random(2)
    texts = [r[1] for r in rows if tokens(r[1])]
    items = [(i, text) for i, text in enumerate(texts[:20])] + [(100, ""), (101, None), (None, texts[0]), (103, "a b"), (104, "w1 w2"), (0, texts[0])]
    for i in range(105, 140):
        words = tokens(rng.choice(texts))
        at = rng.randrange(len(words))
        piece = words[at : at + rng.choice((5, 8, 30, 80))]
        if len(piece) > 6 and rng.random() < 0.5:
            piece[rng.randrange(len(piece))] = "other"
        items.append((i, " ".join(piece).upper()))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = Counter()
    for doc, text, *_ in rows:
        words = tokens(text)
        for item, asked in dict.fromkeys(items):
            want = grams(asked)
            if item is None or not want:
                continue
            size = len(next(iter(want)))
            have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            if 5 * len(want & have) >= 4 * len(want):
                expected[doc, item, len(want), len(want & have)] += 1
    got = decontaminate.contained_items(clashing(docs), bench, block)
    assert Counter((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in got.collect()) == expected
    left = decontaminate.without_benchmark(clashing(docs), bench.where("item_id >= 105"), block)
    gone = {d for d, item, *_ in expected if item >= 105}
    assert {r.doc_id for r in left.collect()} >= {r[0] for r in rows if r[0] is not None} - gone
    assert gone - {None} == {r[0] for r in rows if r[0] is not None} - {r.doc_id for r in left.collect()}


def test_size_partitions():
    for size in (1, 2, 3, 4, 5, 9, 31, 32, 500, 70_000):
        minima, needed = decontaminate.partition_of(size)
        rng = np.random.Generator(np.random.PCG64(size))
        item = np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64))
        found = decontaminate.signature(item)
        assert len(found) == minima and np.isin(found, item).all() and needed >= 4
        if size < 4:
            assert needed == minima and set(found) == set(item)
        else:
            assert minima == decontaminate.SIGNATURE and needed == decontaminate.least_found(minima, 0.8)


@pytest.mark.parametrize("size", [4, 5, 6, 10, 20, 60, 200, 1000])
def test_barely_contained_items_are_found(size):
    """Recall of each size partition where exactly the least share is there, and silence just below it."""
    rng = np.random.Generator(np.random.PCG64(size))
    items = [np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64)) for _ in range(300)]
    sizes = [len(own) for own in items]
    index = decontaminate.ItemIndex.build(list(range(300)), [0] * 300, items, [decontaminate.signature(own) for own in items])
    least = -(-size * 4 // 5)
    for shared, expected in ((least, 300), (least - 1, 0)):
        noise = rng.integers(0, 2**64 - 1, (300, 50), dtype=np.uint64)
        texts = [np.unique(np.r_[rng.permutation(own)[:shared], extra]) for own, extra in zip(items, noise, strict=True)]
        bounds = np.cumsum([0, *(len(t) for t in texts)])
        doc, item, n = index.matches(np.concatenate(texts), bounds)
        assert sizes == [size] * 300 and len(doc) == expected and (doc == item).all() and (n == shared).all()


def test_containment_in_several_passes(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(r.doc_id, r.text) for r in docs.where("doc_id < 60").collect()], "item_id bigint, text string")
    whole = Counter(decontaminate.contained_items(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 3)
    assert Counter(decontaminate.contained_items(docs, bench, 2000).collect()) == whole and whole


def test_containment_of_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contained_items(docs, none).count() == 0
    assert decontaminate.contained_items(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0
    assert decontaminate.least_found(64, 0.8) > 20


# --- 4 ------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in told if r.held_out]
    assert len(told) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in told)
    assert {r.doc_id for r in held} == {r.doc_id for r in told if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_language_mixture(spark):
    en, fr = "the thing that was there and then with them ", "le chat est dans une maison avec les autres "
    model = language.Languages.build(["en", "fr"], np.stack([np.bincount(language.trigrams(pa.array([t * 50]))[0], minlength=language.BINS) for t in (en, fr)]).astype(float))
    best, score = model.predict(pa.array([en * 3, fr * 3, en * 6 + fr * 3, "", en * 4000 + fr * 2000]))
    assert best.tolist() == [0, 1, 0, -1, 0]
    assert score[0] == score[1] == 1 and 0.55 < score[2] < 0.75 and 0.6 < score[4] < 0.7


@pytest.mark.parametrize("block", [1, 2, 4, 128])
def test_language_equals_plain(spark, monkeypatch, block):
    """Likelihoods, mixtures and their selection against plain Python, with languages in blocks of any size."""
    rng = random.Random(7)
    said = {lang: [some_letters(rng) for _ in range(40)] for lang in ("aa", "bb", "cc", "dd", "ee")}
    speak = lambda lang, n: " ".join(rng.choice(said[lang]) for _ in range(n))
    learned = [(lang, speak(lang, 80)) for lang in said for _ in range(4)]
    asked = [speak(lang, n) for lang in said for n in (1, 3, 30)]
    asked += [f"{speak(a, n)} {speak(b, m)}" for a, b in (("aa", "bb"), ("ee", "cc")) for n, m in ((30, 30), (60, 20), (5, 1), (25, 200))]
    asked += [" ".join(speak(lang, 40) for lang in ("aa", "cc", "dd"))]
    counts = np.stack([np.bincount(language.trigrams(pa.array([t for k, t in learned if k == lang]))[0], minlength=language.BINS) for lang in said])
    monkeypatch.setattr(language, "LANGUAGE_BLOCK", max(block, 3))  # a mixture has at most as many
    best, score = language.Languages.build(list(said), counts.astype(float), block).predict(pa.array(asked))
    for text, lang, share in zip(asked, best, score, strict=True):
        mixture = plain_language(learned, text)
        assert list(said)[lang] == max(mixture, key=mixture.get) and abs(mixture[list(said)[lang]] - share) < 1e-3
    assert ((score > 0.2) & (score < 0.9)).sum() >= 5


def test_more_languages_than_a_block(spark):
    """900 languages: none is dropped, and texts between two blocks' languages are mixtures of them."""
    rng = random.Random(11)
    said = {f"l{i:03d}": [some_letters(rng) for _ in range(12)] for i in range(900)}
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), lang) for i, (lang, words) in enumerate((x for x in said.items() for _ in range(4)))]
    both = [(10_000 + i, " ".join([*said[a] * 3, *said[b] * 2]), None) for i, (a, b) in enumerate((("l001", "l899"), ("l700", "l010"), ("l400", "l401")))]
    docs = spark.createDataFrame([*rows, *both], "doc_id bigint, text string, lang string").repartition(8)
    got = {r.doc_id: r for r in language.predict_languages(docs).collect()}
    assert len(got) == len(rows) + 3
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert len(learned) == 900 and all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[10_000 + i].lang_pred for i in range(3)] == ["l001", "l700", "l400"]
    assert all(0.5 < got[10_000 + i].score < 0.7 for i in range(3))


def test_language_counts_of_a_task_are_passed_on(spark, monkeypatch):
    rng = random.Random(3)
    parts = [language._coded(*language.trigrams(pa.array([some_text(rng, 50)] * 3)), np.array([5, k, 5])) for k in range(4)]
    code, n = language._summed(parts)
    plain = Counter()
    for own, many in parts:
        plain.update(dict(zip(own.tolist(), many.tolist(), strict=True)))
    assert dict(zip(code.tolist(), n.tolist(), strict=True)) == plain and (np.diff(code) > 0).all()


def test_language_of_a_very_long_text(monkeypatch):
    """Tables are read some trigrams at a time; a word may be cut."""
    rng = random.Random(4)
    text = pa.array(["x" * 5000, " ".join(some_letters(rng) for _ in range(3000)), "y"])
    bins, first, _ = language.trigrams(text)
    table = np.random.Generator(np.random.PCG64(1)).integers(-9, 10, (language.BINS, 3)).astype(np.float32)  # sums are exact
    whole = np.add.reduceat(table[bins], first, axis=0)
    for numbers in (3, 10, 3000):
        monkeypatch.setattr(language, "NUMBERS_AT_ONCE", numbers)
        assert (language._likely(table, bins, first) == whole).all()


def test_language_on_odd_rows(docs, empty, rows):
    got = language.predict_languages(clashing(docs)).collect()
    assert len(got) == len(rows)
    lettered = {text: any(c.isalpha() for c in text or "") for _, text, *_ in rows}
    by_id = dict((r[0], r[1]) for r in rows if r[0] is not None)
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not lettered[by_id[r.doc_id]])
    assert language.predict_languages(empty).count() == 0
    assert {r.lang_pred for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 5 ------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (1000, 1000), (3000, 2**64 - 1), (3000, 50)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        level = EliasFano.build(values, top)
        if n:
            asked = np.r_[values, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True)]
            assert (level.get(np.arange(n)) == values).all()
            first, end = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), n)
            assert (level.successor(asked, first, end) == np.searchsorted(values, asked)).all()


def test_trie_round_trip():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    pairs = np.unique(np.stack([np.sort(rng.integers(0, len(words), 2000)).astype(np.uint64), rng.choice(words, 2000)], axis=1), axis=0)
    owner, context = pairs[:, 0].astype(np.int64), pairs[:, 1]
    values = rng.normal(size=len(owner))
    trie = Trie.load(Trie.dump(Trie.build(words, np.arange(len(words)), np.zeros(len(words)), owner, context, values)))
    at = trie.find_pairs(owner, context)
    assert (at == np.arange(len(owner))).all() and np.abs(trie.pair_table[trie.pair_code[at]] - values).max() < 0.05
    assert (trie.find_words(words + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("hot", [False, True])
def test_lm_scores(docs, rows, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(lm_scores, "LEAST_HOT_WORD", 20)
        monkeypatch.setattr(lm_scores, "LEAST_HOT_PAIR", 3)
    got = lm_scores.lm_scores(clashing(docs), prior=50.0, shard_bytes=60_000).collect()
    assert len(got) == len(rows)
    end = "\0"
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 5
    said = [(i, [*tokens(text), end]) for i, text, *_ in rows]
    count, pairs = Counter(), Counter()
    for i, words in said:
        if fold(i) != 1:
            count.update(words)
            pairs.update(zip([end, *words], words, strict=False))
    n, distinct = sum(count.values()), len(count)
    unknown = (sum(c == 1 for c in count.values()) + 0.5) / (n + 1)
    p = lambda w: (1 - unknown) * count[w] / n if count[w] else unknown
    expected = defaultdict(list)
    for i, words in said:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in words)
        score = sum(math.log10((pairs[h, w] + 50 * p(w)) / (count[h] + 50)) for h, w in zip([end, *words], words, strict=False))
        expected[i].append((len(words), sum(count[w] > 0 for w in words), base, score, fold(i) == 1))
    for r in got:
        fits = [e for e in expected[r.doc_id] if e[:2] == (r.n_tokens, r.n_known)]
        assert r.train_tokens == n and fits
        assert any(abs(e[2] - r.base_score) < 1e-5 and abs(e[3] - r.score) < 0.02 * e[0] + 0.01 and e[4] == r.held_out for e in fits)


def test_lm_without_texts(spark, empty):
    assert lm_scores.lm_scores(empty).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_scores.lm_scores(spark.createDataFrame([(held, "a b", None, None, 0)], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_lm_pairs_of_hot_words_are_quantised_in_the_trie():
    n = 300  # contexts seen 1, 2, ... times before one hot word: more numerators than codes
    text = " ".join(f"c{k} h" for k in range(1, n + 1) for _ in range(k))
    part = pa.record_batch([pa.array([1, 2, 3]), pa.array([text] * 3)], names=["doc_id", "text"])
    part = part.filter(pa.array(lm_scores._training(part))).slice(0, 1)
    word, context, row = lm_scores.tokens(part)
    totals = lm_scores.Totals(len(word), n + 2, 1, np.unique(word[1:2]), np.array([n * (n + 1) // 2]))
    no = np.zeros(0, dtype=np.int64)
    hot_pairs = Trie.build(totals.hot, totals.hot_counts, totals.unigram(totals.hot_counts), no, no.astype(np.uint64), np.zeros(0))
    sent = lm_scores._block_rows(totals, Trie.mapped(hot_pairs), 1, 0, [(word, context, row, np.array([True]))], part.column("doc_id")).slice(1)
    block = {name: sent.column(name)[0].as_py() for name in sent.schema.names if name != "doc_id"} | {"doc_id": sent.column("doc_id")}
    told = next(lm_scores._answer([block], totals))
    tops = np.frombuffer(told.column("tops")[0].as_py(), dtype="<i2")[block["cold"] :] / lm_scores.TOP_SCALE
    exact = np.log10(np.arange(1, n + 1) + totals.prior * 10 ** totals.unigram(totals.hot_counts))
    width = np.ptp(exact) / 256
    assert len(tops) == n * (n + 1) // 2 and len(np.unique(tops)) <= 256
    assert np.abs(np.sort(tops) - np.repeat(exact, np.arange(1, n + 1))).max() < width + 1 / lm_scores.TOP_SCALE


# --- 6 ------------------------------------------------------------------------------


@pytest.mark.parametrize("usual, block", [(2048, 1 << 20), (2, 300)])
def test_jaccard_equals_brute_force(docs, rows, monkeypatch, usual, block):
    monkeypatch.setattr(jaccard_join, "USUAL_KEY", usual)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    sets = [grams(r[1]) for r in rows]
    tops = brute_components(sets)
    least = defaultdict(list)
    for k, r in zip(tops, rows, strict=True):
        if r[0] is not None:
            least[k].append(r[0])
    expected = Counter((r[0], len(s), min(least[k]) if s and least[k] else r[0]) for r, s, k in zip(rows, sets, tops, strict=True))
    got = jaccard_join.jaccard_components(clashing(docs)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    if usual > 2:
        stays = jaccard_join.first_of_each(clashing(docs))
        assert stays.columns == [*docs.columns, *CLASHES]
        groups = {k for k, s in zip(tops, sets, strict=True) if s}
        assert sum(bool(grams(r.text)) for r in stays.collect()) == len(groups)
        assert sum(not grams(r.text) for r in stays.collect()) == sum(not s for s in sets)


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.first_of_each(empty).count() == 0


def test_signature_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (5, 40, 40, 300)]
    sets = []
    for _ in range(150):
        own = base[rng.integers(4)].copy()
        own[rng.random(len(own)) < rng.choice((0, 0.03, 0.08, 0.3))] = rng.integers(0, 2**63)
        sets.append(np.unique(own))
    found = Tree(sets, [(int(s[0]), len(s)) for s in sets]).connect()
    plain = brute_components([set(s.tolist()) for s in sets])
    assert len(set(zip(found.tolist(), plain, strict=True))) == len(set(plain)) == len(set(found.tolist()))
    assert linked(sets[0], sets[0]) and not linked(base[1], base[2])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(500)]
    root = {n: n for e in edges for n in e}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    linked_ = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: top(n) for n in linked_}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 7 ------------------------------------------------------------------------------


def test_gif_round_trip_of_every_text(docs, rows, empty):
    got = gif.payload_features(gif.store_texts(clashing(docs))).collect()
    expected = Counter()
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        expected[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == expected
    assert gif.payload_features(gif.store_texts(empty)).count() == 0


def test_lzw_round_trip():
    rng = random.Random(6)
    for size in (2, 4, 8):
        for data in (b"", b"\1", bytes(70_000), bytes(rng.randrange(1 << size) for _ in range(30_000)), bytes([0, 1, 2, 1] * 9000)):
            assert gif.lzw_decode(gif.lzw_encode(data, size), size, len(data)) == data


def image(w, h, samples, left=0, top=0, disposal=0, delay=5, transparent=None, interlaced=False):
    flags = disposal << 2 | (transparent is not None)
    out = b"\x21\xf9\x04" + bytes([flags]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0])
    out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 if interlaced else 0])
    coded = gif.lzw_encode(bytes(samples), 2)
    return out + b"\2" + bytes([len(coded)]) + coded + b"\0"


def picture(*images, w=2, h=2):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\x81\0\0" + palette + b"\x21\xfe\2hi\0" + b"".join(images) + b"\x3b"


def seen(data):
    return [f.canvas.copy() for f in gif.frames(data)]


def test_gif_frames(spark):
    red, green, blue = ([255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255])
    one = image(2, 2, [1, 1, 1, 1])
    kept = seen(picture(one, image(1, 1, [2], 1, 1, gif.KEEP), image(1, 1, [3])))
    assert kept[2].tolist() == [[blue, red], [red, green]]
    back = seen(picture(one, image(1, 1, [2], 1, 1, gif.TO_BACKGROUND), image(1, 1, [3])))
    assert back[2].tolist() == [[blue, red], [red, [0, 0, 0, 0]]]
    before = seen(picture(one, image(1, 1, [2], 1, 1, gif.TO_PREVIOUS), image(1, 1, [3])))
    assert before[2].tolist() == [[blue, red], [red, red]]
    clear = seen(picture(one, image(2, 2, [2, 0, 0, 2], transparent=0)))
    assert clear[1].tolist() == [[green, red], [red, green]]
    rows_ = seen(picture(image(1, 8, [0, 1, 2, 3, 0, 1, 2, 3], interlaced=True), w=1, h=8))[0][:, 0]
    black = [0, 0, 0, 255]
    # stored are rows 0, 4, 2, 6, 1, 3, 5, 7
    assert rows_.tolist() == [black, black, green, red, red, green, blue, blue]
    data = [(1, picture(one, image(1, 1, [2], delay=7))), (2, b"GIF89a"), (3, None), (4, b"no"), (5, picture(one)[:-9])]
    got = gif.gif_frames(spark.createDataFrame(data, "id int, media binary"), "id").collect()
    assert [(r.start_ms, r.delay_ms) for r in got if r.id == 1] == [(0, 50), (50, 70)]
    assert sum(next(r for r in got if r.id == 1).histogram) == 4
    assert {r.id for r in got if r.error} >= {2, 4} and not [r for r in got if r.id == 3]


# --- 8 ------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"hot_segments": 3, "shard_words": 2000}])
def test_substrings_equal_brute_force(docs, rows, options):
    expected = Counter((r[0], n, m, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, m, kept) in zip(rows, brute_removal([r[1] for r in rows]), strict=True))
    got = substring_dedup.removal_digests(clashing(docs), **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected


def test_substrings_rewritten(docs, rows, empty):
    out = substring_dedup.without_repeats(clashing(docs))
    assert out.columns == [*docs.columns, *CLASHES]
    expected = Counter((r[0], kept if m else r[1]) for r, (n, m, kept) in zip(rows, brute_removal([r[1] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == expected
    assert substring_dedup.removal_digests(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


def test_fm_index_equals_counting():
    rng = np.random.default_rng(7)
    for _ in range(120):
        length, kinds = int(rng.integers(2, 8)), int(rng.integers(1, 8))
        seqs = []
        for _ in range(int(rng.integers(1, 12))):
            own = rng.integers(0, kinds, int(rng.integers(0, 40))).tolist()
            if seqs and rng.random() < 0.6:
                own = list(seqs[int(rng.integers(len(seqs)))])
                for _ in range(int(rng.integers(0, 3))):
                    if own:
                        own[int(rng.integers(len(own)))] = int(rng.integers(0, kinds + 2))
            seqs.append(own)
        weights = rng.integers(1, 3, len(seqs))
        bounds = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
        if not bounds[-1]:
            continue
        count = Counter()
        for s, w in zip(seqs, weights, strict=True):
            for i in range(len(s) - length + 1):
                count[tuple(s[i : i + length])] += int(w)
        expected = [{k for i in range(len(s) - length + 1) if count[tuple(s[i : i + length])] > 1 for k in range(i, i + length)} for s in seqs]
        index = FMIndex(np.array([x for s in seqs for x in s], dtype=np.uint64) * np.uint64(977), bounds, weights)
        found = [set() for _ in seqs]
        for seq, first, end in zip(*index.repeated(length), strict=True):
            found[seq] |= set(range(first, end))
        assert found == expected


# --- 9 ------------------------------------------------------------------------------


def test_mix(docs, rows):
    got = mixing.mix_sources(clashing(docs), block_words=16).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    targets, taken = brute_targets(sizes), Counter()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(tokens(r[1]))) for r in rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 2
    again = mixing.mix_sources(docs.repartition(3), block_words=16).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_apportionment_goes_to_the_highest_quotients(spark):
    rng = random.Random(8)
    units = [(g, u, rng.choice((0, 1, 3, 50, 1000, 33333))) for g in range(12) for u in range(rng.randrange(1, 9))]
    seats = {g: rng.choice((0, 1, 2, 7, 60)) for g in range(12)}
    seats |= {g: 0 for g in range(12) if not sum(v for x, _, v in units if x == g)}
    df = spark.createDataFrame([(g, u, v, seats[g]) for g, u, v in units], "g int, u int, v long, s long")
    got = {(r.g, r.u): r.q for r in mixing.apportion(df, ["g"], "u", "v", "s", "q").collect()}
    for g, n in seats.items():
        own = {u: [v, 0] for x, u, v in units if x == g}
        for _ in range(n):
            best = max(own, key=lambda u: (own[u][0] / (2 * own[u][1] + 1), -u))
            own[best][1] += 1
        assert {u: got[g, u] for u in own} == {u: k for u, (_, k) in own.items()}


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_sources(empty).count() == 0
    one = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 0)], SCHEMA)
    assert [(r.size, r.taken) for r in mixing.mix_sources(one).collect()] == [(0, 0), (0, 0)]


def test_mix_of_tiny_sources(spark):
    """A long tail of sources below a few blocks beside a large one, and alone."""
    tail = [(n, "w " * n, None, f"t{n:02}", 0) for n in range(1, 66)] + [(100 + n, "w " * (n % 9), None, "t65", 0) for n in range(20)]
    got = mixing.mix_sources(spark.createDataFrame([*tail, (0, "w " * 100_000, None, "a", 0)], SCHEMA)).collect()
    of_tail = Counter()
    for r in got:
        of_tail[r.source] += r.taken - 2 * r.size if r.source != "a" else 0
    assert max(map(abs, of_tail.values())) <= 1
    assert abs(sum(r.taken - r.target for r in got if r.source == "a")) <= 2
    taken, target = Counter(), {}
    for r in mixing.mix_sources(spark.createDataFrame(tail, SCHEMA)).collect():
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and len(target) == 65


def test_mix_of_tiny_sources_by_sql(spark):
    """The query's rule and its SQL are one, whatever the sizes of the sources."""
    rng = random.Random(65)
    tail = [(n, "w " * rng.randrange(200), None, f"t{n % 65:02}", 0) for n in range(320)]
    tail += [(1000, "w " * 50_000, None, "a", 0), (1001, None, None, None, 0), (1002, "w w", None, None, 0), (7, "w " * 90, None, "t07", 0)]
    database = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in tail], "text": [r[1] for r in tail], "source": pa.array([r[3] for r in tail], pa.string())})
    database.register("documents", documents)
    columns = ["doc_id", "size", "source", "source_size", "taken"]
    expected = database.execute(f"SELECT {', '.join(columns)} FROM ({OP9_SQL})").fetchall()
    got = mixing.mix_sources(spark.createDataFrame(tail, SCHEMA)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def test_mix_keeps_documents(spark):
    """All columns of the taken documents, clashing names and repeated rows included, with what ``mix_sources`` takes of them."""
    rng = random.Random(66)
    rows_ = [(i, some_text(rng, rng.randrange(60)), None, f"s{i % 4}", 0) for i in range(200)]
    rows_ += [rows_[5]] * 30 + [(3, "other text under a known id", None, "s3", 0), (None, None, None, None, None), (None, "a b", None, None, None)]
    docs = spark.createDataFrame(rows_, SCHEMA).withColumn("size", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_taken", F.lit(2))
    got = mixing.mixed_documents(docs)
    assert got.columns == [*docs.columns, "_size", "source_size", "target", "taken"]
    got = got.collect()
    texts = Counter(tuple(r)[:5] for r in got)
    assert not texts - Counter(rows_) and all(r._size == len(tokens(r.text)) and 0 < r.taken <= 2 * r._size and r.size == "x" for r in got)
    plain_ = mixing.mix_sources(docs).where("taken > 0").collect()
    assert Counter(r.source for r in got) == Counter(r.source for r in plain_)
    assert sum(r.taken for r in got) == sum(r.taken for r in plain_)
    single = {r.doc_id: r.taken for r in got if r.doc_id is not None and r.doc_id not in (3, 5)}
    assert single == {r.doc_id: r.taken for r in plain_ if r.doc_id is not None and r.doc_id not in (3, 5)}


def test_mix_over_shards(spark):
    rng = random.Random(9)
    rows_ = [(i, some_text(rng, rng.randrange(1, 80)), None, "a" if i % 3 else f"s{i % 5}", 0) for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows_, SCHEMA), block_words=16, shard_words=1000).collect()
    taken, target = Counter(), {}
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.03 * t + 100 for s, t in target.items())


# --- 10 -----------------------------------------------------------------------------


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    from lexmill.llm.queries import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    expected = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.token_counts(clashing(docs), vocabulary_path()).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(empty, vocabulary_path()).count() == 0


def test_token_counts_of_strange_texts():
    from tokenizers import Tokenizer

    from lexmill.llm.queries import vocabulary_path

    rng = random.Random(10)
    library, merges = Tokenizer.from_file(vocabulary_path()), token_counts.Merges(vocabulary_path())
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3001, "it's WE'LL 's", " \n\n  x ", "\x1c\x1f\x85​　.", "½²Ⅷ"]
    parts = ["a", "aa", "the ", "<|endoftext|>", " ", "\r\n", " ", "'re", "٣", "̀", "🙂", "漢"]
    texts += ["".join(rng.choices(parts, k=300)) for _ in range(40)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0x2FF), rng.randrange(0x300, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)))) for _ in range(200)) for _ in range(40)]
    texts.append(" ".join(rng.choices(parts, k=400_000)))  # longer than a piece
    assert merges.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, None)], "doc_id bigint")
    assert [r.f for r in df.select(fold_of(F.col("doc_id")).alias("f")).collect()] == [zlib.crc32(b"0") % 5, zlib.crc32(b"7") % 5, zlib.crc32(b"-3") % 5, None]


def test_frequent_keys_do_not_tie_what_does_not_agree(spark, monkeypatch):
    """Classes that share one key alone stay apart however many they are; near copies under it are still tied."""
    monkeypatch.setattr(jaccard_join, "USUAL_KEY", 8)
    keys = [[0, *(100 * i + k for k in range(1, 32))] for i in range(30)]
    marks = [bytes(random.Random(i).randrange(256) for _ in range(64)) for i in range(30)]
    keys[7], marks[7] = [*keys[5][:20], *keys[7][20:]], marks[5][:40] + marks[7][40:]
    rows = list(zip(range(30), map(bytearray, marks), keys, strict=True))
    classes = spark.createDataFrame(rows, "class bigint, marks binary, keys array<bigint>")
    assert {(max(t), min(t)) for t in jaccard_join._possible_ties(classes).collect()} == {(7, 5)}
    # a pair of keys that is frequent itself ties all to the first class
    same = classes.withColumn("keys", F.array(*[F.lit(k).cast("bigint") for k in range(32)]))
    assert {min(t) for t in jaccard_join._possible_ties(same).collect()} == {0}


def test_keys_of_one_class_move_once_and_without_marks(spark):
    """Only rows under a shared key go on, with their number and first class; the others moved the marks along."""
    rows = spark.createDataFrame([(3, 1), (1, 1), (2, 1), (1, 5), (2, 6), (4, None)], "class bigint, key bigint")
    shared = jaccard_join._shared_keys(rows.withColumn("marks", F.lit(b"m" * 64)))
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "marks" not in plan[: plan.index("Exchange")]
    assert sorted(shared.select("class", "key", "_n", "_hub").collect()) == [(1, 1, 3, 1), (2, 1, 3, 1), (3, 1, 3, 1)]
