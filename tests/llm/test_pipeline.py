"""The pipeline stage by stage: near-duplicates and packing against brute force, the other stages against what their operators report row by
row, which tests of their own hold against plain loops."""

import gc
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline as P
from provspark.llm import mixing, packing, pii, quality, similar, tokens
from provspark.llm.common import batch, map_batches
from tests.llm.test_similar import brute
from tests.llm.test_tokens_packing import single, whole


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    good = lambda n: " ".join(r.choice(["the", "garden", "walked", "slowly,", "towards", "evening."]) + str(r.randrange(900)) * (r.random() < 0.8) for _ in range(n))
    rows = [(i, good(r.randint(60, 300)), r.choice(["en", "de"]), r.choice(["hot", "hot", "a", "b"])) for i in range(200)]
    rows += [(200 + i, rows[i][1], "en", "a") for i in range(30)]
    rows += [(300 + i, rows[50 + i][1] + " mail me@host.example or call +49 30 1234567", "en", "b") for i in range(20)]
    rows += [(400 + i, "Junk line!! ###\n" * 60, "en", "hot") for i in range(20)] + [(500, None, None, None), (501, "", "en", "a"), (None, good(100), "en", "a"), (7, rows[7][1], rows[7][2], rows[7][3])]
    path = tmp_path_factory.mktemp("docs")
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS fp", "2 AS kept", "3 AS bucket")
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (str(r.doc_id), r.text)
    one = P.quality_rules(spark, docs, folder)
    kept = {(str(r.doc_id)) for r in quality.verdicts(docs).collect() if r.kept}
    assert one.columns == docs.columns and {str(r.doc_id) for r in one.collect()} == kept and not any(400 <= int(k) < 502 for k in kept - {"None"})
    one = one.cache()
    two = P.near_dedup(spark, one, folder)
    rows = one.collect()
    # Five words and a Jaccard similarity of 0.8, by all pairs.
    of = brute([frozenset(similar.shingles((r.text or "").encode()).tolist()) for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[of[i]].append(r)
    got = two.collect()
    assert two.columns == docs.columns and len(got) == len(groups)
    first = sorted(str(min((r.doc_id for r in g if r.doc_id is not None), default=None)) for g in groups.values())
    assert sorted(str(r.doc_id) for r in got) == first
    two = spark.createDataFrame(got, two.schema)
    three = P.mask_pii(spark, two, folder)
    machine = pii.automaton()
    assert sorted(map(key, three.collect())) == sorted((str(r.doc_id), pii.masked(r.text, machine)) for r in got)
    assert not any(re.search(r"@host|\+49", r.text) for r in three.collect())
    four = P.mix(spark, three, folder)
    want = sorted(str(r.doc_id) for r in mixing.mixed(three).collect() if r.kept)
    assert four.columns == docs.columns and sorted(str(r.doc_id) for r in four.collect()) == want
    four = four.cache()
    five = P.pack(spark, four, folder).collect()
    lengths = [len(whole(r.text)) + 1 for r in four.collect()]
    assert sum(r.length for r in five) == sum(lengths)
    assert len({r.sequence_id for r in five}) == len(single([m for n in lengths for m in [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0)], 2048))


def test_run(spark, folder):
    rows = P.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert [n for n, _ in P.STAGES] == ["quality rules", "near dedup", "pii", "mix", "pack"]


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_workers_forget(spark):
    """Words that packing remembers go when a worker turns to another step, whose memory they would count against."""
    docs = spark.range(8).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(8)

    def probe():
        def make():
            held = sum(type(x) is tokens.Words for x in gc.get_objects())
            return lambda rows: batch(pa.schema([("n", pa.int64())]), n=[held] * rows.num_rows)

        return {r.n for r in map_batches(docs, ["doc_id"], make, "n long").collect()}

    assert len(packing.packed(docs).collect()) == 8
    assert probe() == {0}
    assert len(packing.packed(docs).collect()) == 8
