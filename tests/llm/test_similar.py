"""Near-duplicates at a Jaccard similarity: against brute force over all pairs of true shingle sets."""

import random

import numpy as np
import pytest

from provspark.llm import similar as S


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(sets, similarity=S.SIMILARITY):
    """The number of each row's component, by all pairs."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity - 1e-9:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def corpus():
    """Families of texts with words replaced, from barely to far too different, and one large family of near copies."""
    r = random.Random(11)
    rows = []
    for family in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 400))]
        rows.append(" ".join(words))
        for changed in (0.0, 0.005, 0.015, 0.02, 0.1):
            other = [f"x{r.randrange(5000)}" if r.random() < changed else w for w in words]
            rows.append(" ".join(other).upper() if family % 3 else "\n".join(other))
    base = [f"h{r.randrange(5000)}" for _ in range(300)]
    for _ in range(60):
        other = list(base)
        other[r.randrange(300)] = f"y{r.randrange(5000)}"
        rows.append(" ".join(other))
    return rows


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_components_against_all_pairs(spark, block):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, block=block).collect()}
    sets = [frozenset(S.shingles(t.encode()).tolist()) for t in texts]
    want = brute(sets)
    assert len(got) == len(texts)
    # Nothing is joined that chains of true links don't join.
    assert all(want[d] == want[c] for d, c in got.items())
    # Links are found by the share that the method promises at the least; here nearly all are above 0.8.
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= S.SIMILARITY]
    found = sum(got[i] == got[j] for i, j in links)
    assert found >= 0.95 * len(links) and len(links) > 1500
    assert len({got[i] for i in range(360, 420)}) == 1


def test_decoding_is_maximum_likelihood():
    book = S.signs(S.codewords())
    assert book.shape == (23, 4096) and set(np.unique(book)) == {-1.0, 1.0}
    # Codewords are at least 7 bits apart, so that 3 wrong signs of equal margin are put right.
    m = np.zeros((50, 64 * S.LANES), np.int64)
    r = np.random.default_rng(2)
    sent = r.integers(0, 4096, (50, S.SEGMENTS))
    for i in range(50):
        for s in range(S.SEGMENTS):
            x = book[:, sent[i, s]].copy()
            x[r.choice(23, 3, replace=False)] *= -1
            m[i, 23 * s : 23 * s + 23] = 5 * x
    assert (S.decoded(m, book) == sent).all()


def test_forest_connects_what_is_near():
    r = np.random.default_rng(5)
    words = r.integers(0, 1 << 63, (40, 3)).astype(np.uint64)
    words[10:30] = words[0]
    words[10:30, 0] ^= np.uint64(1) << np.arange(20, dtype=np.uint64)
    ids = r.permutation(40).astype(np.int64)
    f = S.Forest(ids, words, S.APART)
    links = set(map(tuple, (sorted(x) for x in f.links(ids, words))))
    assert len(links) < 2 * 21
    near = {ids[0], *ids[10:30]}
    assert {x for e in links for x in e} == near


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977} {i}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "One"), (6, "a b"), (7, long), (8, long + " more"), (8, long), (None, "one"), (None, "alone here now"), (None, "alone HERE now"), (9, "x y z u v"), (10, "dup dup"), (10, "dup dup"), (11, "same id, one text"), (11, "same id, two texts here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS row", "3 AS k_id", "4 AS w0", "5 AS root", "6 AS digest", "7 AS k_none", "8 AS component_id")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 10, 11, 11, 4, 6, 7, 9, None]
    assert {(r.id, r.row, r.k_id, r.w0, r.root, r.digest, r.k_none, r.component_id) for r in got} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(rows) and {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def edges():
    """Pairs of texts of few and of many words at a similarity of 0.8 or a little more or less, some in chains, and a passage that many share."""
    r = random.Random(29)
    rows = []
    for i in range(240):
        n = (9, 13, 22, 40, 94, 210)[i % 6]
        words = [f"e{r.randrange(9000)}" for _ in range(n)]
        rows.append(" ".join(words))
        for _ in range(2):
            # Cut at both ends, so that a fifth of the shingles or one more or less is not shared.
            cut = max(1, round((n - 4) * 0.2) + r.choice((-1, 0, 0, 1)))
            front = r.randint(0, cut)
            words = words[front : len(words) - (cut - front)]
            if len(words) > 5:
                rows.append(" ".join(words))
    passage = [f"p{i}" for i in range(60)]
    for _ in range(150):
        rows.append(" ".join(passage[r.randint(0, 6) :] + [f"q{r.randrange(9000)}" for _ in range(r.randint(2, 12))]))
    return rows


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_no_link_is_lost(spark, block):
    texts = edges()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [frozenset(S.shingles(t.encode()).tolist()) for t in texts]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute(sets)


def test_leading_hashes_and_sketches():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = r.integers(0, n // 5 + 1), r.integers(0, n // 5 + 1)
        y = np.unique(np.concatenate([r.permutation(x)[gone:], r.integers(0, 1 << 63, new).astype(np.uint64)]))
        often = r.permutation(np.concatenate([x[: r.integers(0, len(x) + 1)], r.integers(0, 1 << 63, 50).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        apart = len(x) + len(y) - 2 * shared
        assert S.differing(S.sketch(x), S.sketch(y)) <= apart and S.differing(S.sketch(x), S.sketch(x)) == 0
        for similarity in (0.5, 0.8, 1.0):
            by = np.argsort(often)
            lead = [S.leading(z, often, by, similarity) for z in (x, y)]
            assert all(set(a.tolist()) <= set(z.tolist()) for a, z in zip(lead, (x, y)))
            if jaccard(set(x.tolist()), set(y.tolist())) >= similarity:
                assert np.intersect1d(*lead).size


def test_frequent_shingles_come_last(spark):
    rows = [(i, f"one two three four five six x{i}") for i in range(400)]
    often = S.frequent(spark.createDataFrame(rows, "doc_id long, text string"))
    common = set(S.shingles(b"one two three four five six").tolist())
    assert set(often.tolist()) == common
    h = S.shingles(rows[7][1].encode())
    assert not common & set(S.leading(h, often, np.argsort(often), 0.8).tolist())
