"""SimHash: against brute force over all pairs."""

import random

import numpy as np
import pytest

from provspark.llm import simhash as S


def test_golay_tables():
    code = S.Golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    for w in words[:40]:
        # Within a bit's distance there is always a shared key, from either side.
        for i in range(23):
            own = code.index[w ^ (1 << i)]
            rows, near = code.nearby(np.array([w]))
            assert own in near
    rows, near = code.nearby(words)
    sizes = np.bincount(rows)
    assert set(sizes[code.far[words]]) == {6} and set(sizes[~code.far[words]]) == {1}


def brute(prints: dict[int, int]) -> dict[int, int]:
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("block", [4096, 5])
def test_links_equal_brute_force(spark, block):
    r = random.Random(5)
    prints, n = {}, 0
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 3, 30])):
            x = base
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            prints[n] = x
            n += 1
    prints[n], prints[n + 1] = 0, (1 << 64) - 1
    rows = [(d, int(np.uint64(x).astype(np.int64))) for d, x in prints.items()]
    got = spark.createDataFrame(rows, "doc_id long, fp long")
    found = got.join(S.classes(got, block), "fp").collect()
    assert {x.doc_id: x.component_id for x in found} == brute(prints)


def test_hot_fingerprints(spark):
    docs = spark.createDataFrame([(i, "same words here again" if i % 3 else f"other {i}") for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, 5).collect()}
    assert len(got) == 200 and all(got[i] == (1 if i % 3 else got[i]) for i in range(200))
    assert got == {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "One"), (6, "a b"), (7, long), (8, long), (8, long), (None, "one"), (None, "alone here now"), (9, "x y z u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS digest")
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    of = {(d, f): c for d, f, c in got}
    assert of[1, "0" * 16] == of[2, "0" * 16] == of[3, "0" * 16] == 1
    assert len({c for (d, _), c in of.items() if d in (4, 5)}) == 1
    assert S.near_duplicates(docs.limit(0)).count() == 0
