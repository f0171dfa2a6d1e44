"""Plain versions of the operators, for small tables."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def some_text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{'.' if i % 9 == 8 else ''}" for i in range(n))


def grams(text):
    words = tokens(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(sets):
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


def brute_removal(texts):
    said = [tokens(t, lower=False) for t in texts]
    seen_ = Counter(tuple(w[i : i + 35]) for w in said for i in range(len(w) - 34))
    out = []
    for w in said:
        gone = set()
        for i in range(len(w) - 34):
            if seen_[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def some_letters(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))


def plain_trigrams(text):
    """The trigram bins of each word; only for ASCII."""
    out = []
    for word in re.findall("[a-z]+", text.lower()):
        said = b" " + word.encode() + b" "
        codes = [(said[i - 1] << 16) | (said[i] << 8) | said[i + 1] for i in range(1, len(said) - 1)]
        out.append([(code * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for code in codes])
    return out


def plain_language(learned, text):
    """The languages selected for ``text`` and their shares, from ``learned`` pairs of language and text."""
    names = sorted({lang for lang, _ in learned})
    counts = {lang: Counter() for lang in names}
    for lang, said in learned:
        counts[lang].update(b for word in plain_trigrams(said) for b in word)

    def chance(lang, word):
        total = counts[lang].total() + 0.5 * 65536
        return sum(0.5 * math.log((counts[lang][b] + 0.5) / total) for b in word)

    seen = [[chance(lang, word) for lang in names] for word in plain_trigrams(text)]

    def maximised(allowed):
        shares = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(names))]
        for _ in range(10):
            new = [0.0] * len(names)
            for row in seen:
                joint = [s * math.exp(x - max(row)) for s, x in zip(shares, row, strict=True)]
                for k, j in enumerate(joint):
                    new[k] += j / max(sum(joint), 1e-30) / len(seen)
            shares = new
        fit = sum(max(row) + math.log(max(sum(s * math.exp(x - max(row)) for s, x in zip(shares, row, strict=True)), 1e-30)) for row in seen)
        return shares, fit

    alone = [sum(row[k] for row in seen) for k in range(len(names))]
    best, value = {names[alone.index(max(alone))]: 1.0}, max(alone)
    every, _ = maximised(range(len(names)))
    order = sorted(range(len(names)), key=lambda k: -every[k])
    price = 3.0 * math.log(len(seen) + 1)
    for size in range(2, len(names) + 1):
        shares, fit = maximised(order[:size])
        if fit - price * (size - 1) <= value:
            break
        best, value = dict(zip(names, shares, strict=True)), fit - price * (size - 1)
    return best
