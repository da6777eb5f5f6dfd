"""Quality rules: counts against plain loops, expectation-maximisation against numpy, and both ways of filtering."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from provspark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark):
    r = random.Random(1)
    good = lambda n: " ".join(r.choice(["the", "garden", "walked", "slowly,", "towards", "evening."]) + str(r.randrange(400)) * (r.random() < 0.9) for _ in range(n))
    rows = [(i, good(r.randint(60, 200))) for i in range(300)]
    rows += [(1000 + i, " ".join(w + r.choice(["***", "###"]) for w in good(100).split())) for i in range(30)]
    rows += [(2000 + i, "\n".join(["The same line again!!"] * 40)) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3004, "a b c a b c"), (3005, "w " * 90_000), (3006, "x" * 200_000), (None, good(99)), (3007, "é 漢字\x85 y\n\n y\ny \ny "), (3008, good(80)), (3008, good(80))]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS posterior")


def plain(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).cache()


def test_counts_equal_loops(docs):
    got = Q.verdicts(docs).toPandas()
    want = Counter((d if d is not None else -1, *plain(t)) for d, t in docs.select("doc_id", "text").toPandas().replace({np.nan: None}).itertuples(index=False))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((int(r[0]) if r[0] == r[0] else -1, *map(int, r[1:])) for r in got[["doc_id", *counts]].itertuples(index=False)) == want
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    assert not got[got.base_failed].kept.any()
    kept = set(got[got.kept].doc_id.dropna())
    assert not any(1000 <= d < 3000 for d in kept) and sum(d < 300 for d in kept) > 290


def test_maximisation_equals_numpy(docs):
    rows = Q.judged(docs, ["doc_id"]).cache()
    votes = np.array([[int(v) for v in r[0].split(",")] for r in rows.select("_q_votes").collect()])
    n, k = votes.shape
    prior, g, b = Q.PRIOR, np.full(k, Q.ON_GOOD), np.full(k, Q.ON_BAD)
    chance = lambda: 1 / (1 + np.exp(np.log((1 - prior) / prior) + ((votes == 1) * np.log((1 - b) / g) + (votes == -1) * np.log(b / (1 - g))).sum(1)))
    for _ in range(7):
        q = chance()[:, None]
        prior = (q.sum() + Q.SMOOTH) / (n + 2 * Q.SMOOTH)
        g = (((votes == 1) * q).sum(0) + Q.ON_GOOD * Q.TRUST * n) / (((votes != 0) * q).sum(0) + Q.TRUST * n)
        b = (((votes == -1) * (1 - q)).sum(0) + Q.SMOOTH) / (((votes != 0) * (1 - q)).sum(0) + 2 * Q.SMOOTH)
    want = {",".join(map(str, v)): p for v, p in zip(votes, chance())}
    got = {r._q_pattern: r._q_posterior for r in Q.posteriors(rows, 7).collect()}
    assert got == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_filter_keeps_the_same_rows(docs):
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in Q.verdicts(docs).collect() if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert Q.verdicts(docs.limit(0)).count() == 0 and Q.keep_good(docs.limit(0)).count() == 0


def test_clashing_names(docs):
    clash = docs.selectExpr("*", "7 AS _q_text", "'x' AS _q_votes", "8 AS _q_kept", "9 AS _q_pattern", "10 AS row", "11 AS _q_stats", "12 AS _q_posterior")
    kept = Q.keep_good(clash)
    assert kept.columns == clash.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in Q.keep_good(docs).collect())
    assert {(r._q_text, r._q_votes, r._q_kept, r._q_pattern, r.row, r._q_stats, r._q_posterior) for r in got} == {(7, "x", 8, 9, 10, 11, 12)}
    assert Q.verdicts(clash).count() == docs.count()
