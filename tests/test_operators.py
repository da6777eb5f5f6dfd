"""Operators on hand-made rows: the edges that the queries' tables don't have."""

import math
import random

import pytest

from pyspark.sql import functions as F

from provspark.functions import scalars as S
from provspark.operators import chain, documents, graph, metrics, policy, trust


def one(spark, column, **values):
    row = spark.createDataFrame([(1,)], "x int").select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("y")).first()[0]


def test_scalars(spark):
    got = spark.range(1).select(
        S.vendor(F.lit("My-GPT by Anthropic")).alias("vendor"), S.confidence_bar(F.lit(0.125)).alias("bar"), S.parse_iso_ms(F.lit("junk")).alias("bad"), S.parse_iso_ms(F.lit("2024-01-01T00:00:00.250Z")).alias("ms"),
        S.token_seq(F.lit("AAAA")).alias("short"), S.is_cross(F.lit(S.CROSS_DOCUMENT + "ab")).alias("no_node"), S.ref_node(F.lit(S.CROSS_DOCUMENT + "ab#x#y")).alias("node"), S.clamp(F.lit(7.0)).alias("clamped"), S.short_list(F.array(F.lit("a"))).alias("ids"),
    ).first()
    assert tuple(got) == ("anthropic", "██" + "░" * 10, 0, 1704067200250, None, False, "x#y", 1.0, "a")


def test_distribution_rules(spark):
    nan, inf = math.nan, math.inf
    rows = [(0.5, 0.1, 0.1, 0.9, True), (1.1, 0.1, None, None, False), (0.5, -1.0, None, None, False), (0.5, inf, None, None, False), (nan, 0.1, None, None, False), (0.5, nan, None, None, False), (0.5, 0.1, 0.9, 0.1, False), (0.5, 0.1, 0.9, None, True), (None, 0.1, None, None, False)]
    df = spark.createDataFrame(rows, "mean double, var double, p5 double, p95 double, ok boolean")
    c = F.col
    assert df.filter(metrics.distribution_ok(c("mean"), c("var"), c("p5"), c("p95")) != c("ok")).count() == 0
    cov = spark.createDataFrame([([1.0, 2.0], [], True), ([1.0, 2.0], [[1.0, 0.0], [0.0, 1.0]], True), ([1.0, 2.0], [[1.0, 0.0]], False), ([1.0, 2.0], [[1.0], [0.0]], False)], "e array<double>, v array<array<double>>, ok boolean")
    assert cov.filter(metrics.covariance_ok(c("e"), c("v")) != c("ok")).count() == 0


def test_mixtures(spark):
    rows = [("a", 0.25), ("a", 0.75), ("b", 0.5), ("b", 0.6), ("c", 1.5), ("c", -0.5), ("d", math.inf), ("e", math.nan)]
    got = {r.k: r.valid for r in metrics.mixture_valid(spark.createDataFrame(rows, "k string, w double"), "k", "w", F.lit(True)).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}
    free = {r.k: r.valid for r in metrics.mixture_valid(spark.createDataFrame(rows, "k string, w double"), "k", "w", F.lit(False)).collect()}
    assert free == {"a": True, "b": True, "c": True, "d": False, "e": False}


def test_statuses(spark):
    rows = [([], "UNSIGNED"), (["valid"], "VALID"), (["valid", "unverifiable"], "UNVERIFIABLE"), (["unverifiable", "invalid"], "INVALID")]
    df = spark.createDataFrame(rows, "s array<string>, want string")
    assert df.filter(trust.document_status(F.col("s")) != F.col("want")).count() == 0


def test_broken_chains(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a"), (3, 5, None)]
    df = chain.linked(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", F.col("t"))
    good = chain.verdicts(chain.checked(df, "k", "i"), "k", "i")
    assert {r.k: (r.hops, r.broken_links, r.first_broken) for r in good.collect()} == {1: (3, 0, None), 2: (1, 0, None), 3: (1, 0, None)}
    bad = df.withColumn("context_ref", F.when((F.col("k") == 1) & (F.col("i") == 1), "forged").otherwise(F.col("context_ref")))
    checked = chain.trusted_prefix(chain.checked(bad, "k", "i"), "k", "i")
    assert [(r.link_ok, r.in_trust) for r in checked.filter("k = 1").orderBy("i").collect()] == [(True, True), (False, False), (True, False)]
    ring = spark.createDataFrame([("x", "y"), ("y", "x")], "content_id string, context_ref string")
    assert chain.lineage(ring, F.col("content_id") == "x", depth=5).count() == 6


def test_policy_without_rules(spark):
    rows = [("a", "", None, None, "m", None), ("b", "Checksum", "s", "ok", "m", 0.1), ("c", "No CHECKSUM", "s", "ok", "m", 0.1)]
    docs = spark.createDataFrame(rows, "artifact_id string, decode_error string, signer string, key_status string, model string, confidence double")
    got = {r.artifact_id: r.failure_code for r in policy.evaluate(docs, policy.Policy()).collect()}
    assert got == {"a": None, "b": "TAMPERED", "c": "FORMAT"}
    low = policy.evaluate(docs, policy.Policy(minimum_confidence=0.5)).filter("artifact_id = 'a'").first()
    assert low.allowed  # no nodes count as certain


def test_policy_fails_closed(spark):
    rows = [("a", "", "s", None, "m", None), ("b", "", "s", "later", "m", None), ("c", "", "s", "ok", "m", None), ("d", "", None, None, "m", None)]
    docs = spark.createDataFrame(rows, "artifact_id string, decode_error string, signer string, key_status string, model string, confidence double")
    got = {r.artifact_id: r.failure_code for r in policy.evaluate(docs, policy.Policy(check_keys=True)).collect()}
    assert got == {"a": "SIGNATURE_INVALID", "b": "SIGNATURE_INVALID", "c": None, "d": "UNSIGNED"}
    with pytest.raises(ValueError):
        policy.evaluate(docs, policy.Policy(check_crl=True))


def test_recorded_calls(spark):
    rows = [(1, [("f", "c1")], [("r", "c1")], "text", ["first", "second"]), (2, [], [], "text", [])]
    df = spark.createDataFrame(rows, "id int, calls array<struct<name: string, call_id: string>>, results array<struct<content: string, call_id: string>>, text string, thoughts array<string>")
    got = {r.id: r for r in documents.nodes_of_calls(df).collect()}
    assert [n.type for n in got[1].nodes] == ["tool_call", "tool_result", "text"] and got[1].trace[1].deps == ["thought_0"]
    assert [n.id for n in got[2].nodes] == ["n0"] and got[2].trace == []


def test_roles_and_keys(spark):
    claims = spark.createDataFrame([("open", "a"), ("held", "a"), ("held", "b"), ("closed", "a")], "role string, signer string")
    grants = spark.createDataFrame([("held", "a"), ("closed", None)], "role string, signer string")
    got = {(r.role, r.signer): r.authorized for r in trust.role_checked(claims, grants).collect()}
    assert got == {("open", "a"): True, ("held", "a"): True, ("held", "b"): False, ("closed", "a"): False}


def test_lineage_of_long_chains_and_rings(spark):
    rows = [(f"k{i}", f"k{i - 1}" if i else "") for i in range(200)] + [("t", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    df = spark.createDataFrame(rows, "content_id string, context_ref string")
    got = {(r.origin, r.content_id): r.depth for r in chain.lineage(df, F.col("content_id").isin("k199", "k3", "t")).collect()}
    want = {("k199", f"k{i}"): 199 - i for i in range(200)} | {("k3", f"k{i}"): 3 - i for i in range(4)} | {("t", c): i for i, c in enumerate("txyz")}
    assert got == want


def test_stuck_has_no_bound_of_rounds(spark):
    chain_of = [("long", str(i), str(i - 1)) for i in range(1, 1500)]
    ring = [("ring", str(i), str((i + 1) % 5)) for i in range(5)] + [("ring", str(i), str(i - 1)) for i in range(5, 40)]
    r, mixed = random.Random(2), []
    for g in range(30):
        mixed += [(f"g{g}", str(i), str(r.randrange(i) if r.random() < 0.93 else r.randrange(12))) for i in range(1, 12) for _ in range(r.randint(0, 3))]
    mixed += [("g0", "3", "absent"), ("g1", "4", "4")]
    edges = chain_of + ring + mixed
    nodes = {(g, i) for g, i, _ in edges} | {(g, d) for g, _, d in edges if d != "absent"} | {("none", "0")}
    want = set()
    for g in {g for g, _ in nodes}:
        ids = sorted(i for h, i in nodes if h == g)
        want |= {(g, i) for i in graph.in_row_stuck(ids, [[d for h, j, d in edges if (h, j) == (g, i)] for i in ids])}
    for whole in (graph.WHOLE, 30):  # folded whole, and the larger ones peeled by joins
        got = graph.stuck(spark.createDataFrame(sorted(nodes), "graph string, id string"), spark.createDataFrame(edges, "graph string, id string, dep string"), whole).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {i for g, i in want if g == "ring"} == {str(i) for i in range(40)} and not any(g == "long" for g, _ in want) and any(g[0] == "g" for g, _ in want)
