"""Raking: marginals, both ways of working, and drawn rows."""

import random

import numpy as np
import pytest
import xxhash

from provspark.llm import mixing as M


def corpus(spark, n=3000):
    r = random.Random(4)
    rows = [(i, " ".join(["word"] * r.randint(1, 30)) + r.choice(["", " 1 2 3 4 5 6 7 8 9", " | | | | |"]), r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "a", "b"])) for i in range(n)]
    rows += [(None, None, None, None), (None, "", "en", "a"), (7, "same", "de", "b"), (7, "same", "de", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS topic", "2 AS tokens", "3 AS factor")


def test_marginals_equal_targets(spark):
    docs = corpus(spark).filter("source IS NOT NULL AND text <> ''")  # else a cell alone on two sides has two targets
    table = M.probabilities(M.placed(docs), {"source": {"hot": 0.2, "a": 0.5, "b": 0.3, "absent": 0.4}}).toPandas()
    w = table.tokens * table.factor
    by = (w.groupby(table.source).sum() / w.sum()).to_dict()
    assert by["hot"] / by["a"] == pytest.approx(0.4) and by["b"] / by["a"] == pytest.approx(0.6)
    want = M.tempered(table.tokens.groupby(table.lang).sum().to_dict(), M.TEMPER)
    assert (w.groupby(table.lang).sum() / w.sum()).to_dict() == pytest.approx(want, rel=1e-4)
    assert table.probability.max() == 1 and table.probability.min() > 0


def test_frames_equal_arrays(spark):
    table = M.cells(M.placed(corpus(spark, 300)))
    a = M.rake_frames(table, rounds=4).toPandas().sort_values(list(M.SIDES))
    b = M.rake([tuple(x) for x in a[list(M.SIDES)].to_numpy()], a.tokens.to_numpy(), rounds=4)
    assert np.allclose(a.factor, b)
    by = M.scale(a.tokens.to_numpy(), b, 0.7)
    assert M.scale_frames(spark.createDataFrame(a), 0.7) == pytest.approx(by, rel=1e-6)
    assert (a.tokens * np.minimum(1, by * b)).sum() == pytest.approx(0.7 * a.tokens.sum())


def test_rows(spark):
    docs = corpus(spark)
    got = M.mixed(docs).toPandas()
    assert len(got) == 3004
    kept = M.sample(docs)
    assert kept.columns == docs.columns and kept.count() == got.kept.sum()
    expected = (got.n_tokens * got.probability).sum()
    assert expected == pytest.approx(0.8 * got.n_tokens.sum(), rel=1e-3)
    assert got[got.kept].n_tokens.sum() == pytest.approx(expected, rel=0.04)
    less = M.mixed(docs.filter("source IS NOT NULL"), keep=0.4).toPandas()
    share = less[less.kept].groupby("source").n_tokens.sum() / less[less.kept].n_tokens.sum()
    want = M.tempered(less.groupby("source").n_tokens.sum().to_dict(), M.TEMPER)
    assert share.to_dict() == pytest.approx(want, abs=0.05)
    assert M.mixed(docs.limit(0)).count() == 0 and M.sample(docs.limit(0)).count() == 0
    words = got[got.doc_id == 0].n_tokens.iloc[0]
    text = docs.filter("doc_id = 0").first().text
    assert words == len(text.split()) + 1


def test_shares_meet_feasible_targets_at_the_kept_share():
    r = np.random.default_rng(7)
    names = [(s, l, t) for s in "abcdef" for l in ("de", "en", "es") for t in ("prose", "table", "numeric")]
    tokens = np.array([{"a": 30, "b": 9, "c": 5, "d": 3, "e": 2, "f": 1}[s] * {"en": 6, "de": 2, "es": 1}[l] * {"prose": 20, "table": 2, "numeric": 0.5}[t] for s, l, t in names]) * r.uniform(0.5, 1.5, len(names))
    p = M.bounded(names, tokens, M.rake(names, tokens), M.KEEP)
    assert p.min() > 0 and p.max() == 1 and (tokens * p).sum() == pytest.approx(M.KEEP * tokens.sum())
    for k in range(3):
        values = sorted({n[k] for n in names})
        at = np.array([values.index(n[k]) for n in names])
        have, kept = np.bincount(at, tokens), np.bincount(at, tokens * p)
        want = M.tempered(dict(zip(values, have)), M.TEMPER)
        share = np.array([want[v] for v in values])
        assert kept == pytest.approx(M.bounded_goals(have, share, M.KEEP * tokens.sum()), rel=1e-4)
        free = kept < have * (1 - 1e-6)
        assert free.any() and np.ptp((kept / share)[free]) < 1e-3 * (kept / share)[free].max()
        assert (kept / share)[~free].max(initial=0) <= (kept / share)[free].max() * (1 + 1e-3)


def test_bounded_frames_near_bounded_arrays(spark):
    a = M.rake_frames(M.cells(M.placed(corpus(spark, 300).filter("source IS NOT NULL AND text <> ''"))), rounds=10).toPandas()
    want = M.bounded([tuple(x) for x in a[list(M.SIDES)].to_numpy()], a.tokens.to_numpy(), a.factor.to_numpy(), 0.7)
    got = M.bounded_frames(spark.createDataFrame(a), 0.7, rounds=6).toPandas().set_index(list(M.SIDES)).x.clip(upper=1)
    assert got.loc[[tuple(x) for x in a[list(M.SIDES)].to_numpy()]].to_numpy() == pytest.approx(want, abs=0.03)


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "word " * (40 if i else 200_000), "en", "a", -7, "mine", 0.5, True, 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _m_tokens long, _g_source string, _m_p double, _m_kept boolean, row long")
    kept = M.sample(docs)
    got = kept.collect()
    assert kept.columns == docs.columns and 0 < len(got) <= 20 and all(tuple(r) == rows[r.doc_id] for r in got)
    assert {r.doc_id for r in got} == {r.doc_id for r in M.mixed(docs).collect() if r.kept}
    assert M.mixed(docs).filter("doc_id = 0").first().n_tokens == 200_001


def test_targets_and_topics_from_tables(spark):
    docs = spark.createDataFrame([(i, "word " * 9, "en", "a", "law" if i % 4 else "art") for i in range(4000)], "doc_id long, text string, lang string, source string, subject string")
    goal = spark.createDataFrame([("topic", "law", 0.5), ("topic", "art", 0.5)], "side string, value string, share double")
    got = M.mixed(docs, goal, 0.4, "subject").toPandas()
    share = got[got.kept].groupby("topic").n_tokens.sum() / got[got.kept].n_tokens.sum()
    assert set(got.topic) == {"law", "art"} and share.to_dict() == pytest.approx({"law": 0.5, "art": 0.5}, abs=0.04)
    assert M.sample(docs, goal, 0.4, "subject").count() == got.kept.sum()
    with pytest.raises(ValueError):
        M.given(spark.createDataFrame([("look", "x", 0.5)], "side string, value string, share double"))


def lot(*parts) -> float:
    """The number that decides: XXH64 of the parts one after another, each seeded with the one before, in 2 ** 32ths."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, h)
    return h % (1 << 32) / (1 << 32)


def test_draws_equal_brute_force(spark):
    docs = corpus(spark, 800)
    texts = sorted(((r.doc_id, r.text, r.source or "", r.lang or "") for r in docs.collect()), key=str)
    got = sorted(M.mixed(docs).collect(), key=lambda r: str((r.doc_id, r.source, r.lang)))
    p = {(r.source, r.lang, r.topic): r.probability for r in got}
    # Cells and their tokens in plain loops, then the same arrays' raking.
    cells = {}
    for r in got:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    names = sorted(cells)
    tokens = np.array([cells[n] for n in names], float)
    want = M.bounded(names, tokens, M.rake(names, tokens), M.KEEP)
    assert [p[n] for n in names] == pytest.approx(want, abs=2e-9)
    drawn = sorted(((r.doc_id, r.kept) for r in got), key=str)
    mine = []
    for d, t, source, lang in texts:
        topic = {x.topic for x in got if (x.doc_id, x.source, x.lang) == (d, source, lang)}
        assert len(topic) == 1 and len((t or "").split()) + 1 in {x.n_tokens for x in got if x.doc_id == d}
        mine.append((d, lot((42).to_bytes(4, "little"), None if d is None else d.to_bytes(8, "little", signed=True), t) < p[source, lang, topic.pop()]))
    assert sorted(mine, key=str) == drawn
