"""Manifest, one-permutation near duplicates and conversation trie against plain versions, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from plain import some_text, tokens
from pyspark.sql import functions as F

from lexmill.llm import conversation_trie, merkle, near_duplicates

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- Merkle manifest -------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 3 * 3
        out.append((nodes[first:i], nodes[i + 1 : first + 3]))
        i //= 3
    return out


def plain_audit(rows, tampered):
    sources = defaultdict(list)
    for row in rows:
        sources[row["source"]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(plain_leaf(r, r["text"]))))
    trees = {name: levels_of([plain_leaf(r, r["text"]) for r in sources[name]]) for name in names}
    over = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(sources[name]):
            path = siblings(trees[name], i) + siblings(over, k)
            node = plain_leaf(row, tampered(row))
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(x for left, right in path for x in left + right))
            root = over[-1][0]
            out.append((row["doc_id"], plain_leaf(row, row["text"]), trees[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_steps", [1, 2, 6])
def test_manifest_against_plain(spark, monkeypatch, block_steps):
    """Null and empty values, repeated ids and rows, a source of one row and a long one; blocks of 3, 9 and 729."""
    monkeypatch.setattr(merkle, "STEPS", block_steps)
    rng = random.Random(block_steps)
    rows = [(i, rng.choice([None, "", "a\nb", "é\n" * 3, "x" * 5000 + "\n"]), rng.choice([None, "vi"]), "big", rng.choice([None, i])) for i in range(91)]
    rows += [(i, f"t{i}\n", "en", source, i) for i, source in enumerate([None, None, "", "é", "z", "Z"])]
    rows += [(None, "no id\n", None, "big", None), (5, "same", "en", "dup", 1), (5, "same", "en", "dup", 1), (5, "other", "en", "dup", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("place", F.lit("mine")).withColumn("TREE", F.lit(1))
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))

    def tampered(row):
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        return row["text"].replace("\n", "") if hit and row["text"] is not None else row["text"]

    got = merkle.audit(docs, {"text": lost}).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    want = plain_audit([dict(zip(names, r, strict=True)) for r in rows], tampered)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.verified for r in got} == {True, False}
    by_source = {r.source: (r.n_leaves, r.root) for r in merkle.manifest(docs).collect()}
    assert by_source["big"] == (92, want[0][3]) and by_source[None][0] == 2


def test_a_fold_resumes_the_copied_state():
    digests = [digest(str(i)).encode() for i in range(20)]
    block = merkle.Block(digests, 0)
    for place in range(20):
        changed = [*digests[:place], digest("new").encode(), *digests[place + 1 :]]
        assert block.fold(place, changed[place]) == merkle.Block(changed, 0).root
        assert block.fold(place, digests[place]) == block.root


def test_manifest_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.audit(empty).collect() == [] and merkle.manifest(empty).collect() == []
    row = merkle.audit(spark.createDataFrame([(1, None, None, None, None)], DOCS)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest()


# --- near duplicates ---------------------------------------------------------------


def four_grams(text):
    words = tokens(text)
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def plain_components(sets):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def family(rng, size, words, edits):
    base = some_text(rng, words).split()
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(own))
    return out


def checked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect()}
    sets = [four_grams(t) for t in texts]
    tops = plain_components(sets)
    assert got == {i: (len(s), tops[i], tops[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_against_plain(spark):
    """Families around the threshold, chains, tiny sets, copies, null, empty and very long texts."""
    rng = random.Random(5)
    texts = [None, "", "  \n", "one", "one", "ONE", "one two three", "one two three four"]
    for words, edits in ((60, 3), (150, 8), (400, 25), (24, 1)):
        texts += family(rng, 40, words, edits)
    for length in range(4, 14):  # sets of 1 to 10 shingles and what one more word makes of them
        base = [f"k{length}_{i}" for i in range(length)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(["less", *base]), " ".join([*base, "more", "still"])]
    chain = some_text(rng, 300).split()
    for step in range(12):
        texts.append(" ".join(chain))
        chain[step * 20 : step * 20 + 4] = [f"c{step}_{i}" for i in range(4)]
    long = some_text(rng, 60_000, words=50_000)
    texts += [long, long + " tail", some_text(rng, 500)]
    rng.shuffle(texts)
    checked(spark, texts)


def test_near_duplicates_in_hot_buckets_and_small_blocks(spark, monkeypatch):
    """All texts share boilerplate; buckets, hub parts and blocks are so small that every way of cutting is taken."""
    monkeypatch.setattr(near_duplicates, "BUCKET", 8)
    monkeypatch.setattr(near_duplicates, "HUB_MEMBERS", 4)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 10)
    rng = random.Random(9)
    plate = some_text(rng, 80)
    texts = [f"{plate} {some_text(rng, rng.randrange(5, 60))}" for _ in range(70)]
    texts += [f"{plate} {t}" for t in family(rng, 50, 60, 8)]
    checked(spark, texts)


def test_densified_bins_agree_like_the_sets():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**64, (400, 90), dtype=np.uint64)
    bounds = np.arange(401) * 80
    left = near_duplicates.signatures(np.sort(both[:, :80], axis=1).ravel(), bounds)
    right = near_duplicates.signatures(np.sort(both[:, 10:], axis=1).ravel(), bounds)
    assert abs((left == right).mean() - 70 / 90) < 0.02
    assert not (left == near_duplicates.NONE).any()


def test_near_duplicates_of_odd_tables(spark):
    kind = "doc_id bigint, text string, class string, key string"
    assert near_duplicates.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    text = "a b c d e f g h i j k l"
    rows = [(None, text, "x", "y"), (7, text, None, None), (7, text, None, None), (3, text + " m", "", ""), (3, "something else", "", ""), (None, None, "", "")]
    got = sorted(map(tuple, near_duplicates.near_duplicates(spark.createDataFrame(rows, kind)).collect()), key=repr)
    assert got == sorted([(None, 9, 3, None), (7, 9, 3, False), (7, 9, 3, False), (3, 10, 3, True), (3, 1, 3, True), (None, 0, None, None)], key=repr)


# --- conversation trie ---------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = said.get(c - c % 5, [])[:h] + said[c][h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
            if d:
                kids[tuple(rebuilt[c][: d - 1])].add(tuple(rebuilt[c][:d]))
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = [c for c in ids if len(rebuilt[c]) == len(node)]
        out.append((
            ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(kids[node]), sum(not kids[x] for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows):
    turns = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("mine")).withColumn("base", F.lit(1))
    found = conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turn_rows(turns)))
    return sorted(map(tuple, found.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("limits", [(1 << 15, 1 << 12), (7, 3)])
def test_trie_against_plain(spark, monkeypatch, limits):
    """Copies, a hot first turn, absent families, turnless conversations, nulls, ties; also in very small shards."""
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", limits[0])
    monkeypatch.setattr(conversation_trie, "SHARD_CONVERSATIONS", limits[1])
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(200), 90) + [-7, -12]:
        for turn in range(rng.choice([1, 1, 2, 4, 12])):
            text = "hello" if turn == 0 else rng.choice([None, "", "é", "yes", "no"])
            rows.append((c, rng.choice([turn, None, 3]), rng.choice(["user", "user", None, ""]), text))
    rows += [(1000, i, "user", "hello") for i in range(60)] + [(None, 0, "user", "lost")] + [(1005, 0, "user", "a"), (1005, 0, "user", "a")]
    rng.shuffle(rows)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []


def test_trie_of_a_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", 500)
    rows = [(5, i, "user", f"t{i % 7}") for i in range(3000)] + [(10, 0, "user", "t0"), (15, 0, "user", "t0")]
    got = trie_of(spark, rows)
    assert len(got) == 3001 and max(r[1] for r in got) == 3000
    assert [r for r in got if r[1] == 1][0][:4] == (5, 1, 5, 3)
