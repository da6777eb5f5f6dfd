"""Class-based scores: exchange against brute force, scores against a plain sum, and a held-out comparison."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from provspark.llm import brown_lm as B


def likelihood(pairs, of):
    onto = np.zeros((len(of), int(of.max()) + 1))
    onto[np.arange(len(of)), of] = 1
    t = onto.T @ pairs @ onto
    return B.xlogx(t).sum() - B.xlogx(t.sum(0)).sum() - B.xlogx(t.sum(1)).sum()


def test_exchange_reaches_a_local_optimum():
    r = np.random.default_rng(3)
    pairs = r.poisson(2, (24, 24)) + 40.0 * (np.add.outer(np.arange(24), np.arange(24)) % 3 == 0)
    of = B.exchange(pairs, 20, 4, 50)
    best = likelihood(pairs, of)
    for w in range(20):
        for c in range(4):
            other = of.copy()
            other[w] = c
            assert likelihood(pairs, other) <= best + 1e-6
    assert best > likelihood(pairs, B.exchange(pairs, 20, 4, 0))


def documents(spark):
    r = random.Random(8)
    kinds = (["the", "a", "this"], ["cat", "dog", "fish", "bird"], ["runs", "eats", "sees"], ["Quickly", "slowly"])
    rows = [(i, " ".join(r.choice(k) if r.random() < 0.95 else f"rare{r.randrange(300)}" for _ in range(r.randint(0, 30)) for k in kinds)) for i in range(150)]
    return [*rows, (None, "the cat"), (700, "again"), (700, "again"), (500, None), (501, " \t "), (502, "w" * 70_000 + " " + "cat " * 30_000)]


def test_scores_equal_plain_sums(spark):
    rows = documents(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS rid")
    got = B.scores(docs, kernel=8, head=20).collect()
    assert len(got) == len(rows)
    train = Counter(w for d, t in rows if not B.held_out(d) for w in B.tokens((t or "").encode()))
    n, v = sum(train.values()), len(train)
    want = {}
    for d, t in rows:
        words = B.tokens((t or "").encode())
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.setdefault(d, []).append((d is not None and zlib.crc32(str(d).encode()) % 10 == 0 or d is None, len(words), sum(train[w] > 0 for w in words), n, base))
    for r in got:
        w = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    check_model(rows, docs, got, train)
    small = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in small) > sum(r.base_score for r in small)


def check_model(rows, docs, got, train):
    """Scores from classes alone: all counts are made anew in plain loops."""
    keyed = B.keyed(docs)
    m, beyond = B.learn(keyed, B.word_counts(keyed), 8, 20)
    t = m.table
    beyond = {bytes(r.word): (r.c, r.cls) for r in beyond.collect()}
    held = {w: int(t.cls[i]) for w, i in t.index.items()}
    assert len(held) <= 21 and set(held).isdisjoint(beyond) and {w for w, n in train.items() if n >= B.LEAST} <= held.keys() | beyond.keys()
    assert all(c == train[w] for w, (c, _) in beyond.items())
    of = lambda w: held[w] if w in held else beyond[w][1] if w in beyond else t.rare
    after = lambda w: held.get(w, t.rare)
    # Every word with two occurrences or more is clustered, none of the others.
    assert all((of(w) < t.classes) == (n >= B.LEAST) for w, n in train.items() if w != B.END) and of(B.END) == t.end
    pairs = np.zeros((t.many, t.many))
    learnt = [B.tokens((x or "").encode()) for d, x in rows if not B.held_out(d)]
    for words in learnt:
        for a, b in zip([B.END, *words], words):
            pairs[after(a), of(b)] += 1
    room = np.zeros(t.many)
    for w, n in train.items():
        room[of(w)] += n + B.ADD
    room[t.rare] += B.ADD
    share = (pairs.sum(0) + B.ADD) / (pairs.sum() + B.ADD * t.many)
    trans = (pairs + B.WEIGHT * share) / (pairs.sum(1, keepdims=True) + B.WEIGHT)
    assert trans.sum(1) == pytest.approx(1)
    for r in got:
        words = B.tokens((next(x for d, x in rows if d == r.doc_id) or "").encode())
        total = sum(math.log10(trans[after(a), of(b)] * (train[b] + B.ADD) / room[of(b)]) for a, b in zip([B.END, *words], words))
        assert r.score == pytest.approx(total, rel=1e-9)
    # The last batch: every word beyond the dictionary is in the class that its left contexts make likeliest, given the dictionary's counts.
    dense, left = np.zeros((t.many, t.many)), {}
    for words in learnt:
        for a, b in zip([B.END, *words], words):
            if b in held:
                dense[after(a), of(b)] += 1
            else:
                left.setdefault(b, Counter())[after(a)] += 1
    share = (dense.sum(0) + B.ADD) / (dense.sum() + B.ADD * t.many)
    logs = np.log10((dense + B.WEIGHT * share) / (dense.sum(1, keepdims=True) + B.WEIGHT)) - np.log10(dense.sum(0) + B.ADD)
    for w, hs in left.items():
        if train[w] >= B.LEAST:
            gains = sum(n * logs[h, : t.classes] for h, n in hs.items())
            assert gains[of(w)] == pytest.approx(gains.max())
    assert len(left) > 100


def test_numbers_of_words_equal_sparks(spark):
    words = [b"", b"a", b"the", "\u00e9t\u00e9".encode(), b"x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "word binary").selectExpr("shiftrightunsigned(xxhash64(word), 9) AS w")
    assert [r.w for r in df.collect()] == [B.number(w) for w in words]


def test_frequent_words_fill_the_room(spark):
    df = spark.createDataFrame([(b"w%d" % i, 7) for i in range(500)] + [(b"top", 90)], "word binary, n long")
    got = B.frequent(df, 100)
    assert got[0] == (b"top", 90) and 20 <= len(got) <= 100
    assert len(B.frequent(df, 501)) == 501


def test_empty(spark):
    assert B.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
