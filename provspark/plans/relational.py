"""Queries over tables that play the layers of artifacts: a turn is a document of a chain, an order a task, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provspark.functions import scalars as S
from provspark.operators import chain, documents, export, graph, metrics, policy, replay, trust, windows
from provspark.plans.registry import query, table

# --- chains: turns of a conversation name the turn before

TURN = "concat_ws('|', conv_id, turn, coalesce(text, ''))"
BAD = "conv_id % 7 = 3 AND turn = 1"
CHAIN_SQL = f"""
c AS (SELECT conv_id, turn, sha256({TURN}) AS content_id FROM conversations),
l AS (SELECT *, coalesce(lag(content_id) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context_ref FROM c),
t AS (SELECT conv_id, turn, context_ref, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN sha256(content_id || '!') ELSE content_id END AS real FROM l),
k AS (SELECT *, context_ref = coalesce(lag(real) OVER (PARTITION BY conv_id ORDER BY turn), '') AS link_ok FROM t)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return chain.linked(table(spark, d, "conversations").select("conv_id", "turn", F.expr(TURN).alias("content")), "conv_id", "turn", F.col("content")).drop("content")


def tampered(spark: SparkSession, d: str) -> DataFrame:
    real = F.when(F.expr(BAD), F.sha2(F.concat("content_id", F.lit("!")).cast("binary"), 256)).otherwise(F.col("content_id"))
    return chain.checked(turns(spark, d), "conv_id", "turn", real)


@query(f"WITH {CHAIN_SQL} SELECT conv_id, turn, content_id, context_ref FROM l")
def chain_build(spark, d):
    return turns(spark, d)


@query(f"WITH {CHAIN_SQL} SELECT conv_id, count(*) AS hops, count(*) FILTER (NOT link_ok) AS broken_links, min(turn) FILTER (NOT link_ok) AS first_broken FROM k GROUP BY conv_id")
def chain_verify(spark, d):
    return chain.verdicts(tampered(spark, d), "conv_id", "turn")


@query(f"WITH {CHAIN_SQL} SELECT conv_id, turn, link_ok, max(CASE WHEN link_ok THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) = 0 AS in_trust FROM k")
def chain_tamper_cascade(spark, d):
    return chain.trusted_prefix(tampered(spark, d), "conv_id", "turn").select("conv_id", "turn", "link_ok", "in_trust")


@query(f"""WITH RECURSIVE {CHAIN_SQL}, top AS (SELECT conv_id, max(turn) AS turn FROM c GROUP BY conv_id),
w AS (SELECT l.content_id AS origin, l.content_id, l.context_ref, 0 AS depth FROM l JOIN top USING (conv_id, turn)
UNION ALL SELECT w.origin, l.content_id, l.context_ref, w.depth + 1 FROM w JOIN l ON l.content_id = w.context_ref)
SELECT origin, content_id, depth FROM w""")
def chain_lineage(spark, d):
    rows = turns(spark, d)
    last = rows.groupBy("conv_id").agg(F.max_by("content_id", "turn").alias("_last"))
    marked = rows.join(last, "conv_id").withColumn("_start", F.col("content_id") == F.col("_last"))
    return chain.lineage(marked, F.col("_start"))


@query("""SELECT doc_id, m.sha256 AS listed, sha256(coalesce(text, '')) AS actual,
CASE WHEN text IS NULL AND d.doc_id IS NULL THEN 'missing' WHEN m.sha256 IS NULL THEN 'unlisted' WHEN m.sha256 = sha256(coalesce(text, '')) THEN 'ok' ELSE 'mismatch' END AS status
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256('forged') ELSE sha256(coalesce(text, '')) END AS sha256 FROM documents WHERE doc_id % 13 <> 0) m FULL JOIN documents d USING (doc_id)""")
def manifest_verify(spark, d):
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    listed = docs.filter("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("forged").cast("binary"), 256)).otherwise(F.sha2(text.cast("binary"), 256)).alias("sha256"))
    return chain.manifest_checked(listed, docs, "doc_id", text)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
o AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e)
SELECT user_id, count(*) AS hops, count(*) FILTER (p IS NOT NULL AND ms < p) AS out_of_order FROM o GROUP BY user_id""")
def chain_time_order(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", S.epoch_ms(F.col("ts")).alias("ms"))
    return chain.time_ordered(rows, "user_id", "event_id", "ms").groupBy("user_id").agg(F.count(F.lit(1)).alias("hops"), F.count_if(~F.col("in_order")).alias("out_of_order"))


# --- tasks: an order is a task, its lines are tool results, a returned one is an error


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("pos"), F.lit("tool_result").alias("type"), (F.col("l_returnflag") == "R").alias("is_error"), F.col("l_quantity").cast("bigint").alias("latency_ms"))


@query("SELECT l_orderkey AS task_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'ok' END AS status FROM lineitem GROUP BY 1")
def doc_status(spark, d):
    return documents.failed(results(spark, d), "task_id")


@query("SELECT l_orderkey AS task_id, count(*) AS tool_count, count(*) FILTER (l_returnflag = 'R') AS error_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_ms, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'ok' END AS status FROM lineitem GROUP BY 1")
def task_envelope(spark, d):
    return documents.envelope(results(spark, d), "task_id")


@query("""SELECT o_orderkey AS call_id, l_linenumber AS pos, l_returnflag = 'R' AS is_error, f.l_orderkey IS NOT NULL AS has_result FROM orders
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) f ON l_orderkey = o_orderkey AND n = 1""")
def tool_call_pairing(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("rank")
    got = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), key, F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "R").alias("is_error"))
    return documents.paired(calls, got, "call_id", "rank").drop("rank")


@query("""SELECT source_model, l_shipmode AS tool, errors FROM (SELECT p_brand AS source_model, p_type AS l_shipmode, count(*) AS errors FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2)""")
def tool_failures(spark, d):
    bad = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey")
    return bad.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("source_model"), F.col("p_type").alias("tool")).agg(F.count(F.lit(1)).alias("errors"))


# --- confidences and figures


@query("SELECT user_id, count(value) AS n_nodes, round(coalesce(avg(least(1, value / 500)), 1), 6) AS confidence_mean, round(coalesce(avg(value / 10000), 0), 6) AS confidence_var FROM events GROUP BY user_id")
def confidence_summary(spark, d):
    nodes = table(spark, d, "events").select("user_id", F.least(F.lit(1.0), F.col("value") / 500).alias("mean"), (F.col("value") / 10000).alias("var"))
    return metrics.confidence_summary(nodes, "user_id").withColumns({c: F.round(c, 6) for c in ("confidence_mean", "confidence_var")})


@query("""SELECT user_id, count(p) AS n_tokens, round(greatest(0, least(1, avg(p))), 6) AS mean, round(CASE WHEN count(p) = 1 THEN 0.05 ELSE greatest(0, least(1, var_pop(p))) END, 6) AS var
FROM (SELECT user_id, exp(-value / 100) AS p FROM events) GROUP BY user_id""")
def logprob_confidence(spark, d):
    got = metrics.logprob_confidence(table(spark, d, "events").select("user_id", F.exp(-F.col("value") / 100).alias("p")), "user_id", "p")
    return got.withColumns({"mean": F.round("mean", 6), "var": F.round("var", 6)})


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, round(avg(value), 1) AS mean, round(coalesce(stddev_pop(value), 0), 1) AS stdev FROM events GROUP BY event_type")
def run_summary(spark, d):
    return metrics.run_summary(table(spark, d, "events"), ["event_type"], "value", F.col("event_type") != "error")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_linear(spark, d):
    return metrics.percentiles(table(spark, d, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p99")})


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (i = least(n - 1, CAST(round_even(0.5 * n, 0) AS BIGINT))) AS p50, min(value) FILTER (i = least(n - 1, CAST(round_even(0.9 * n, 0) AS BIGINT))) AS p90, min(value) FILTER (i = least(n - 1, CAST(round_even(0.99 * n, 0) AS BIGINT))) AS p99 FROM r GROUP BY event_type""")
def percentile_nearest(spark, d):
    return metrics.nearest_ranks(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH x AS (SELECT event_type, unnest(['value', 'is_error']) AS name, unnest([value, CAST(event_type = 'error' AS DOUBLE)]) AS v FROM events)
SELECT event_type, name, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_pop(v), 0), 6) AS stdev, count(*) FILTER (name = 'is_error' AND v <> 0) AS n_true FROM x WHERE v IS NOT NULL GROUP BY 1, 2""")
def numeric_summary(spark, d):
    rows = table(spark, d, "events").withColumn("is_error", F.col("event_type") == "error")
    return metrics.numeric_summary(rows, ["value", "is_error"], ["event_type"]).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("""WITH s AS (SELECT l_returnflag AS judge, l_linestatus AS criterion, l_discount AS score FROM lineitem),
b AS (SELECT judge, criterion, count(score) AS n, avg(score) AS mean, min(score) AS lowest, max(score) AS highest, stddev_pop(score) AS stdev FROM s GROUP BY 1, 2)
SELECT judge, criterion, n, round(mean, 6) AS mean, lowest, highest, round(stdev, 6) AS stdev FROM b
UNION ALL SELECT judge, '*', CAST(sum(n) AS BIGINT), round(avg(mean), 6), min(lowest), max(highest), round(coalesce(stddev_pop(mean), 0), 6) FROM b GROUP BY judge""")
def judge_scores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("judge"), F.col("l_linestatus").alias("criterion"), F.col("l_discount").alias("score"))
    return metrics.judge_scores(rows, "judge", "criterion", "score").withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("""WITH w AS (SELECT l_orderkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) * CASE WHEN l_orderkey % 5 = 0 THEN 1.1 ELSE 1 END AS w FROM lineitem)
SELECT l_orderkey AS artifact_id, count(*) AS n, round(sum(w), 6) AS total, bool_and(w BETWEEN 0 AND 1) AND abs(sum(w) - 1) <= 0.01 AS valid FROM w GROUP BY 1""")
def alternatives_normalized(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), "l_extendedprice")
    total = rows.groupBy("artifact_id").agg(F.sum("l_extendedprice").alias("all"))
    share = F.col("l_extendedprice") / F.col("all") * F.when(F.col("artifact_id") % 5 == 0, 1.1).otherwise(1.0)
    weights = rows.join(total, "artifact_id").select("artifact_id", share.alias("weight"))
    return metrics.mixture_valid(weights, "artifact_id", "weight", F.lit(True)).withColumn("total", F.round("total", 6))


@query("""SELECT doc_id, (length(coalesce(text, '')) // 4) AS tokens, ((4 * ((strlen(coalesce(text, '')) + 2) // 3)) // 4) AS tokens_base64 FROM documents""")
def token_cost(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", S.approx_tokens(text).alias("tokens"), S.approx_tokens_base64(text.cast("binary")).alias("tokens_base64"))


@query("""SELECT doc_id, CAST((text IS NULL) AS INT) + CAST((length(text) > 2000) AS INT) + CAST((lang <> 'en') AS INT) AS losses,
greatest(0, 1 - 0.1 * (CAST((text IS NULL) AS INT) + CAST((length(text) > 2000) AS INT) + CAST((lang <> 'en') AS INT)))::DOUBLE AS score FROM documents""")
def roundtrip_fidelity(spark, d):
    docs = table(spark, d, "documents")
    return metrics.fidelity(docs, [F.col("text").isNull(), F.char_length("text") > 2000, F.col("lang") != "en"]).select("doc_id", "losses", "score")


@query("""SELECT vec_id, len(embedding) AS dim, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum'), 4) AS norm2 FROM embeddings""")
def embedding_fidelity(spark, d):
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(square, 4).alias("norm2"))


@query("""WITH c AS (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
k AS (SELECT label, list(m ORDER BY pos) AS c FROM c GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 5) AS cosine FROM embeddings JOIN k USING (label)""")
def centroid_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = means.groupBy(F.col("label").alias("_l")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    return rows.join(centre, F.col("label") == F.col("_l")).select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("c")), 5).alias("cosine"))


# --- trust


def signatures(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "invalid").when(F.col("l_linestatus") == "O", "valid").otherwise("unverifiable")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), status.alias("status"))


SIGNED_SQL = """s AS (SELECT l_orderkey AS artifact_id, CASE WHEN l_returnflag = 'R' THEN 'invalid' WHEN l_linestatus = 'O' THEN 'valid' ELSE 'unverifiable' END AS status FROM lineitem),
u AS (SELECT o_orderkey AS artifact_id, o_orderpriority, o_orderstatus, count(status) AS n_signatures, CASE WHEN count(status) = 0 THEN 'UNSIGNED' WHEN bool_or(status = 'invalid') THEN 'INVALID' WHEN bool_and(status = 'valid') THEN 'VALID' ELSE 'UNVERIFIABLE' END AS trust_status
FROM orders LEFT JOIN s ON o_orderkey = s.artifact_id GROUP BY 1, 2, 3)"""


def rolled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), "o_orderpriority", "o_orderstatus")
    return trust.rolled_up(docs, signatures(spark, d))


@query(f"WITH {SIGNED_SQL} SELECT artifact_id, n_signatures, trust_status, CASE trust_status WHEN 'VALID' THEN 0 WHEN 'UNSIGNED' THEN 2 ELSE 1 END AS exit_code FROM u")
def trust_rollup(spark, d):
    return rolled(spark, d).select("artifact_id", "n_signatures", "trust_status", trust.exit_code(F.col("trust_status")).alias("exit_code"))


@query(f"WITH {SIGNED_SQL} SELECT o_orderpriority AS priority, o_orderstatus AS state, trust_status, count(*) AS n FROM u GROUP BY CUBE (1, 2, 3)")
def trust_cube(spark, d):
    return rolled(spark, d).select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"), "trust_status").cube("priority", "state", "trust_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIGNED_SQL} SELECT o_orderpriority AS priority, trust_status, count(*) AS n, grouping(o_orderpriority) * 2 + grouping(trust_status) AS level FROM u GROUP BY ROLLUP (o_orderpriority, trust_status)")
def trust_rollup_levels(spark, d):
    return rolled(spark, d).rollup(F.col("o_orderpriority").alias("priority"), "trust_status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


REVOKE_SQL = """a AS (SELECT o_orderkey AS artifact_id, sha256(CAST(o_orderkey AS VARCHAR)) AS artifact_digest, [CAST(o_custkey AS VARCHAR)] AS signers, CASE WHEN o_orderstatus = 'P' THEN 'INVALID' ELSE 'VALID' END AS trust_status FROM orders),
m AS (SELECT DISTINCT sha256(CAST(l_orderkey AS VARCHAR)) AS d, CASE WHEN l_partkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'other' END AS signer, l_suppkey AS issued_ms, CASE WHEN l_linenumber % 3 = 0 THEN 'bad' ELSE 'good' END AS sig FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""


@query(f"""WITH {REVOKE_SQL}, j AS (SELECT artifact_id, trust_status, count(d) FILTER (sig = 'good' AND list_contains(signers, signer)) AS ok, count(d) FILTER (NOT (sig = 'good' AND list_contains(signers, signer))) AS forged FROM a LEFT JOIN m ON d = artifact_digest GROUP BY 1, 2)
SELECT artifact_id, ok AS revocations_applied, forged AS forged_revocations, CASE WHEN trust_status = 'VALID' AND ok > 0 THEN 'REVOKED' WHEN trust_status = 'VALID' AND artifact_id % 17 = 0 THEN 'UNVERIFIABLE' ELSE trust_status END AS trust_status FROM j""")
def revocation_apply(spark, d):
    orders = table(spark, d, "orders")
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    docs = orders.select(F.col("o_orderkey").alias("artifact_id"), digest("o_orderkey").alias("artifact_digest"), F.array(F.col("o_custkey").cast("string")).alias("signers"), F.when(F.col("o_orderstatus") == "P", "INVALID").otherwise("VALID").alias("trust_status"))
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    told = lines.select(digest("l_orderkey").alias("artifact_digest"), F.when(F.col("l_partkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("other").alias("signer"), F.col("l_suppkey").alias("issued_ms"), F.lit("key_compromise").alias("reason"), F.when(F.col("l_linenumber") % 3 == 0, "bad").otherwise("good").alias("signature"))
    merged = trust.merged_statements(told, told.filter("signature = 'good'"))
    return trust.revoked(docs, merged, F.col("signature") == "good", F.col("artifact_id") % 17 == 0).select("artifact_id", "revocations_applied", "forged_revocations", "trust_status")


@query("SELECT l_orderkey AS artifact_id, l_linenumber AS pos, l_suppkey AS signer FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)")
def key_revocation_filter(spark, d):
    revoked = table(spark, d, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("signer"))
    docs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("signer"))
    return trust.unrevoked(docs, revoked)


@query("""WITH g AS (SELECT s_nationkey AS role, s_suppkey AS signer FROM supplier WHERE s_acctbal > 3000)
SELECT l_orderkey AS artifact_id, l_linenumber AS pos, l_suppkey AS signer, s_nationkey AS role, (s_nationkey NOT IN (SELECT role FROM g) OR EXISTS (SELECT 1 FROM g WHERE g.role = s_nationkey AND g.signer = l_suppkey)) AS authorized FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def role_grants(spark, d):
    suppliers = table(spark, d, "supplier")
    grants = suppliers.filter("s_acctbal > 3000").select(F.col("s_nationkey").alias("role"), F.col("s_suppkey").alias("signer"))
    claims = table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("signer"), F.col("s_nationkey").alias("role"))
    return trust.role_checked(claims, grants)


@query("""WITH k AS (SELECT s_name AS signer, CASE WHEN s_suppkey % 3 = 0 THEN to_base64(encode(repeat('k', 32))) WHEN s_suppkey % 3 = 1 THEN 'AAAA' END AS key_b64 FROM supplier)
SELECT signer, CASE WHEN length(key_b64) = 44 THEN key_b64 END AS key_b64, CASE WHEN key_b64 IS NULL THEN 'resolved' ELSE 'pinned' END AS basis FROM k""")
def signer_keys(spark, d):
    rows = table(spark, d, "supplier")
    known = rows.filter("s_suppkey % 3 < 2").select(F.col("s_name").alias("signer"), F.when(F.col("s_suppkey") % 3 == 0, F.base64(F.lit("k" * 32).cast("binary"))).otherwise("AAAA").alias("key_b64"))
    return trust.resolved_keys(rows.select(F.col("s_name").alias("signer")), known)


@query(f"""WITH b AS (SELECT sha256(coalesce(text, '')) AS cid FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT doc_id AS artifact_id, CASE WHEN doc_id % 3 = 0 THEN 'node' ELSE '{S.CROSS_DOCUMENT}' || sha256(coalesce(text, '')) || '#n' || (doc_id % 2) END AS ref FROM documents)
SELECT artifact_id, ref, CASE WHEN ref = 'node' THEN 'local' ELSE 'cross-document' END AS kind, CASE WHEN ref = 'node' THEN 'local' WHEN split_part(substr(ref, 13), '#', 1) IN (SELECT cid FROM b) AND ref LIKE '%#n0' THEN 'resolved' ELSE 'unresolved' END AS status FROM r""")
def bundle_resolution(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("cid"))
    bundle = docs.filter("artifact_id % 2 = 0").select(F.col("cid").alias("content_id"), F.lit("n0").alias("node_id"))
    ref = F.when(F.col("artifact_id") % 3 == 0, "node").otherwise(F.concat(F.lit(S.CROSS_DOCUMENT), "cid", F.lit("#n"), (F.col("artifact_id") % 2).cast("string")))
    return trust.references(docs.select("artifact_id", ref.alias("ref")), bundle).select("artifact_id", "ref", "kind", "status")


@query("""SELECT o_orderkey AS artifact_id, CASE WHEN o_orderkey % 4 = 0 THEN 'absent' WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'verified' ELSE 'unverified' END AS timestamp_status FROM orders""")
def timestamp_anchors(spark, d):
    orders = table(spark, d, "orders")
    anchors = orders.select(F.col("o_orderkey").alias("artifact_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("authority"), (F.col("o_orderstatus") != "P").alias("token_ok"))
    keys = orders.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("authority"))
    return trust.timestamp_status(anchors, keys, F.col("token_ok")).select("artifact_id", "timestamp_status")


@query("""SELECT o_orderkey AS artifact_id, CASE WHEN a IS NULL THEN 'missing' WHEN a > 157680000000 THEN 'expired' WHEN a < -5000 THEN 'post-dated' ELSE 'ok' END AS age FROM (SELECT o_orderkey, 1009843200000 - CASE WHEN o_orderkey % 9 <> 0 THEN epoch_us(o_orderdate) // 1000 END AS a FROM orders)""")
def signature_age(spark, d):
    ms = F.when(F.col("o_orderkey") % 9 != 0, S.epoch_ms(F.col("o_orderdate")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), trust.age_status(ms, F.lit(1009843200000), 157680000000).alias("age"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'ed25519+ml-dsa-65' WHEN 1 THEN 'ml-dsa-65' ELSE 'rsa' END AS alg, CASE l_suppkey % 3 WHEN 0 THEN 3373 WHEN 1 THEN 3309 ELSE 64 END AS size,
CASE l_linenumber % 4 WHEN 0 THEN 1984 WHEN 1 THEN 1952 WHEN 2 THEN 32 END AS key_size, l_returnflag <> 'R' AS ed, l_linestatus = 'O' AS pq, l_quantity > 25 AS need, l_discount > 0.03 AS backend FROM lineitem)
SELECT l_orderkey AS artifact_id, l_linenumber AS pos, l_partkey AS part, CASE alg WHEN 'ed25519+ml-dsa-65' THEN CASE WHEN size <> 3373 THEN 'invalid' WHEN key_size IS NULL OR key_size NOT IN (1984, 32) THEN 'unverifiable' WHEN NOT ed THEN 'invalid' WHEN NOT need THEN 'valid' WHEN key_size <> 1984 OR NOT backend THEN 'unverifiable' WHEN pq THEN 'valid' ELSE 'invalid' END
WHEN 'ml-dsa-65' THEN CASE WHEN NOT need THEN 'unverifiable' WHEN size <> 3309 THEN 'invalid' WHEN key_size IS NULL OR key_size <> 1952 OR NOT backend THEN 'unverifiable' WHEN pq THEN 'valid' ELSE 'invalid' END ELSE 'unverifiable' END AS status FROM a""")
def pq_gate_matrix(spark, d):
    rows = table(spark, d, "lineitem")
    pick = lambda c, n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(c) % n + 1).cast("int"))
    status = S.pq_status(pick("l_partkey", 3, "ed25519+ml-dsa-65", "ml-dsa-65", "rsa"), pick("l_suppkey", 3, 3373, 3309, 64), pick("l_linenumber", 4, 1984, 1952, 32, None), F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25, F.col("l_discount") > 0.03)
    return rows.select(F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), status.alias("status"))


# --- policy, governance, replay


POLICY_SQL = """p AS (SELECT doc_id AS artifact_id, source AS model, CASE WHEN doc_id % 19 = 0 THEN 'Checksum mismatch' WHEN doc_id % 23 = 0 THEN 'bad magic' ELSE '' END AS e, CASE WHEN doc_id % 5 <> 0 THEN 'key' || (doc_id % 12) END AS signer,
CASE doc_id % 10 WHEN 1 THEN 'revoked' WHEN 2 THEN 'unknown' WHEN 3 THEN 'invalid' WHEN 4 THEN NULL WHEN 6 THEN 'odd' ELSE 'ok' END AS k, least(1, n_chars / 3000.0) AS c FROM documents),
v AS (SELECT artifact_id, model, CASE WHEN e LIKE '%Checksum%' THEN 'TAMPERED' WHEN e <> '' THEN 'FORMAT' WHEN signer IS NULL THEN 'UNSIGNED' WHEN k = 'revoked' THEN 'KEY_REVOKED' WHEN k = 'unknown' THEN 'UNTRUSTED' WHEN coalesce(k, '') <> 'ok' THEN 'SIGNATURE_INVALID'
WHEN signer IN ('key4', 'key9') THEN 'KEY_REVOKED' WHEN model NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 'POLICY_VIOLATION' WHEN signer NOT IN ('key1', 'key4', 'key6', 'key7', 'key8', 'key9', 'key10') THEN 'POLICY_VIOLATION' WHEN c < 0.3 THEN 'POLICY_VIOLATION' END AS failure_code FROM p)"""


def gated(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        i.alias("artifact_id"), F.col("source").alias("model"), F.when(i % 19 == 0, "Checksum mismatch").when(i % 23 == 0, "bad magic").otherwise("").alias("decode_error"), F.when(i % 5 != 0, F.concat(F.lit("key"), (i % 12).cast("string"))).alias("signer"),
        F.when(i % 10 == 1, "revoked").when(i % 10 == 2, "unknown").when(i % 10 == 3, "invalid").when(i % 10 == 6, "odd").when(i % 10 != 4, "ok").alias("key_status"), F.least(F.lit(1.0), F.col("n_chars") / 3000).alias("confidence"),
    )
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    rules = policy.Policy(True, True, True, one("model", [f"src{k}" for k in range(6)]), one("signer", [f"key{k}" for k in (1, 4, 6, 7, 8, 9, 10)]), 0.3)
    return policy.evaluate(docs, rules, one("signer", ["key4", "key9"]))


@query(f"WITH {POLICY_SQL} SELECT artifact_id, failure_code, failure_code IS NULL AS allowed FROM v")
def policy_gate(spark, d):
    return gated(spark, d).select("artifact_id", "failure_code", "allowed")


@query(f"""WITH {POLICY_SQL} SELECT artifact_id, 'fpr_status' AS node_id, 'verification_failure' AS node_type, '{{"status":"invalid","failure_code":"' || failure_code || '","rule_triggered":"default_policy","action":"BLOCKED"}}' AS value, 1.0::DOUBLE AS confidence_mean, model AS source_model FROM v WHERE failure_code IS NOT NULL""")
def failure_records(spark, d):
    return policy.failure_records(gated(spark, d))


#: Events by chain: six a chain, in the order of their kinds, with some made wrong.
GOV_SQL = """e AS (SELECT event_id // 6 AS chain_id, event_id % 6 AS pos, user_id, event_id FROM events),
f AS (SELECT chain_id, pos, user_id, 'e' || CASE WHEN user_id % 11 = 5 AND pos > 0 THEN event_id - 1 ELSE event_id END AS event_id, ['Decision', 'Evidence', 'PolicyEvaluation', 'Review', 'Action', 'Outcome'][CASE WHEN user_id % 7 = 3 THEN 1 ELSE pos + 1 END] AS event_type,
CASE WHEN pos = 0 THEN [] WHEN user_id % 13 = 6 THEN ['e' || (event_id - 1), 'e' || (event_id - 1)] ELSE ['e' || (event_id - 1)] END AS parent_ids, user_id % 9 <> 4 AS signed FROM e)"""


#: Each chain folded event by event.
FOLD_SQL = f"""WITH RECURSIVE {GOV_SQL},
r AS (SELECT chain_id, -1 AS pos, CAST([] AS VARCHAR[]) AS kept, CAST([] AS INTEGER[]) AS kinds, false AS decided, '' AS event_id, '' AS reason FROM (SELECT DISTINCT chain_id FROM f)
UNION ALL SELECT n.chain_id, n.pos, CASE WHEN n.reason = 'verified' THEN list_append(n.kept, n.event_id) ELSE n.kept END, CASE WHEN n.reason = 'verified' THEN list_append(n.kinds, n.kind) ELSE n.kinds END, n.decided OR (n.reason = 'verified' AND n.kind = 1), n.event_id, n.reason FROM (
SELECT f.chain_id, CAST(f.pos AS INTEGER) AS pos, r.kept, r.kinds, r.decided, f.event_id, k.kind, CASE WHEN NOT f.signed THEN 'invalid_signature' WHEN list_contains(r.kept, f.event_id) THEN 'duplicate_event_id'
WHEN (k.kind = 1 AND (len(f.parent_ids) > 0 OR r.decided)) OR (k.kind > 1 AND len(f.parent_ids) = 0) THEN 'invalid_root' WHEN len(list_distinct(f.parent_ids)) < len(f.parent_ids) THEN 'duplicate_parent'
WHEN NOT list_has_all(r.kept, f.parent_ids) THEN 'missing_parent' WHEN len(f.parent_ids) > 0 AND r.kinds[list_position(r.kept, f.parent_ids[1])] >= k.kind THEN 'parent_order' ELSE 'verified' END AS reason
FROM r JOIN f ON f.chain_id = r.chain_id AND f.pos = r.pos + 1 JOIN (SELECT unnest(['Decision', 'Evidence', 'PolicyEvaluation', 'Review', 'Action', 'Outcome']) AS t, unnest([1, 2, 3, 4, 5, 6]) AS kind) k ON k.t = f.event_type) n)"""


@query(f"""{FOLD_SQL}
SELECT chain_id, pos::BIGINT AS pos, event_id, reason = 'verified' AS valid, reason FROM r WHERE pos >= 0""")
def governance_chain(spark, d):
    return policy.governed(governance_events(spark, d)).select("chain_id", "pos", "event_id", "valid", "reason")


def governance_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as checked rows of chains."""
    i, u, pos = F.col("event_id"), F.col("user_id"), F.col("event_id") % 6
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    types = F.array(*[F.lit(t) for t in policy.EVENT_TYPES])
    kind = F.element_at(types, F.when(u % 7 == 3, 1).otherwise((pos + 1).cast("int")))
    none = F.array().cast("array<string>")
    parents = F.when(pos == 0, none).when(u % 13 == 6, F.array(name(i - 1), name(i - 1))).otherwise(F.array(name(i - 1)))
    own = F.when((u % 11 == 5) & (pos > 0), i - 1).otherwise(i)
    rows = table(spark, d, "events").select(F.call_function("div", i, F.lit(6).cast("bigint")).alias("chain_id"), pos.alias("pos"), name(own).alias("event_id"), kind.alias("event_type"), parents.alias("parent_ids"), (u % 9 != 4).alias("signature_ok"))
    actor, yes = F.concat(F.lit("actor/"), F.col("event_type")), F.lit(True)
    roles = F.create_map(*[F.lit(x) for kv in policy.EVENT_ROLES.items() for x in kv])
    full = rows.withColumns({
        "has_signature": yes, "signature_signer": actor, "key_known": yes, "key_revoked": F.lit(False), "event_ok": yes, "signer_id": actor, "actor": actor, "has_provenance": yes, "source_model": actor,
        "provenance_ms": F.lit(1), "timestamp_ms": F.lit(1), "claimed_role": roles[F.col("event_type")], "role_listed": yes, "role_granted": yes, "other_roles_ok": yes,
    })
    return policy.event_reasons(full)


@query("""WITH k AS (SELECT 'sc' || (event_id % 20) AS model, event_id, CASE WHEN event_id % 20 = 1 THEN 'missing_signature' WHEN event_id % 20 = 2 THEN 'missing_signer_binding' WHEN event_id % 20 = 3 THEN 'unknown_signer' WHEN event_id % 20 = 4 THEN 'invalid_signature' WHEN event_id % 20 = 5 THEN 'revoked_signer'
WHEN event_id % 20 = 6 THEN 'invalid_event' WHEN event_id % 20 = 7 THEN 'missing_signer_binding' WHEN event_id % 20 = 8 THEN 'signer_mismatch' WHEN event_id % 20 = 9 THEN 'actor_signer_mismatch' WHEN event_id % 20 = 10 THEN 'expected_signer_mismatch' WHEN event_id % 20 = 11 THEN 'missing_provenance'
WHEN event_id % 20 = 12 THEN 'provenance_actor_mismatch' WHEN event_id % 20 = 13 THEN 'provenance_timestamp_mismatch' WHEN event_id % 20 = 14 THEN 'event_role_mismatch' WHEN event_id % 20 = 15 THEN 'role_authorization_missing' WHEN event_id % 20 IN (16, 17) THEN 'unauthorized_role' ELSE 'verified' END AS reason FROM events)
SELECT event_id, reason, reason = 'verified' AS valid FROM k""")
def governance_event_reasons(spark, d):
    k = F.col("event_id") % 20
    at = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    a, none = F.lit("actor"), F.lit(None).cast("string")
    rows = table(spark, d, "events").select(
        "event_id", (k != 1).alias("has_signature"), at(2, none, F.when(k == 8, "else").otherwise(a)).alias("signature_signer"), (k != 3).alias("key_known"), k.isin(5, 4).alias("key_revoked"), (k != 4).alias("signature_ok"), (k != 6).alias("event_ok"),
        at(7, F.lit(""), a).alias("signer_id"), at(9, F.lit("b"), a).alias("actor"), (k != 11).alias("has_provenance"), at(12, F.lit("b"), F.when(k == 9, "b").otherwise(a)).alias("source_model"), at(13, F.lit(2), F.lit(1)).alias("provenance_ms"), F.lit(1).alias("timestamp_ms"),
        F.lit("Review").alias("event_type"), at(14, F.lit("policy_engine"), F.lit("human_reviewer")).alias("claimed_role"), (k != 15).alias("role_listed"), (k != 16).alias("role_granted"), (k != 17).alias("other_roles_ok"), at(10, F.lit("someone"), a).alias("expected"),
    )
    return policy.event_reasons(rows, F.col("expected")).select("event_id", "reason", "valid")


@query(f"""WITH {GOV_SQL} SELECT chain_id, count(*) AS n_types, count(DISTINCT event_type) AS kinds, count(*) FILTER (NOT signed) AS unsigned FROM f GROUP BY 1""")
def governance_types(spark, d):
    return governance_events(spark, d).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_types"), F.countDistinct("event_type").alias("kinds"), F.count_if(~F.col("signature_ok")).alias("unsigned"))


@query(f"""{FOLD_SQL},
z AS (SELECT chain_id, count(*) FILTER (pos >= 0) AS events, count(*) FILTER (pos >= 0 AND reason <> 'verified') AS failures, max_by(kinds, pos) AS kinds FROM r GROUP BY chain_id)
SELECT chain_id, events, failures, failures = 0 AS trust_valid, failures = 0 AND list_sort(kinds) = [1, 2, 3, 4, 5, 6] AS complete FROM z""")
def governance_summary(spark, d):
    return policy.chain_summary(policy.governed(governance_events(spark, d)))


@query("SELECT event_id, CASE WHEN coalesce(props, '') <> '' THEN row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) > 1 END AS replay FROM events")
def replay_single(spark, d):
    return replay.single(table(spark, d, "events"), "user_id", "props", "event_id").select("event_id", "replay")


@query("""WITH RECURSIVE e AS (SELECT event_id AS arrival, props AS nonce, CASE event_id % 4 WHEN 0 THEN ['nobody'] WHEN 1 THEN [event_type] ELSE [event_type, CAST(user_id % 3 AS VARCHAR)] END AS signers FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY nonce ORDER BY arrival) AS k FROM e WHERE coalesce(nonce, '') <> ''),
r AS (SELECT DISTINCT nonce, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS seen, NULL::BIGINT AS arrival, '' AS status FROM o
UNION ALL SELECT o.nonce, o.k, CASE WHEN list_has_any(r.seen, o.signers) THEN r.seen ELSE list_concat(r.seen, o.signers) END, o.arrival, CASE WHEN list_has_any(r.seen, o.signers) THEN 'replay' ELSE 'fresh' END FROM r JOIN o ON o.nonce = r.nonce AND o.k = r.k + 1)
SELECT arrival, nonce, status FROM r WHERE k > 0 UNION ALL SELECT arrival, nonce, 'no_nonce' FROM e WHERE coalesce(nonce, '') = ''""")
def replay_several(spark, d):
    signers = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 4 == 1, F.array(F.col("event_type"))).otherwise(F.array(F.col("event_type"), (F.col("user_id") % 3).cast("string")))
    return replay.several(table(spark, d, "events").select(F.col("event_id").alias("arrival"), F.col("props").alias("nonce"), signers.alias("signers"))).select("arrival", "nonce", "status")


# --- graphs: parts that depend on parts


EDGE_SQL = """g AS (SELECT p_size AS graph, CAST(p_partkey AS VARCHAR) AS id, CAST(CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 50 ELSE p_partkey - p_partkey % 7 - 1 END AS VARCHAR) AS dep FROM part)"""


def edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_size").alias("graph"), k.cast("string").alias("id"), F.when(k % 10 == 0, k + 50).otherwise(k - k % 7 - 1).cast("string").alias("dep"))
    return rows.select("graph", "id"), rows


@query(f"WITH {EDGE_SQL} SELECT graph, id, dep FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.graph = g.graph AND h.id = g.dep)")
def ref_dangling(spark, d):
    nodes, rows = edges(spark, d)
    return graph.dangling(rows, nodes)


@query("SELECT l_orderkey AS graph, CAST(l_linenumber AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ref_duplicates(spark, d):
    return graph.duplicates(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").cast("string").alias("id")))


CYCLE_SQL = """n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 < 4 THEN p_partkey - p_partkey % 50 + (p_partkey % 50 + 1) % 4 ELSE p_partkey - 1 - p_partkey % 3 END AS dep, p_partkey // 50 AS graph FROM part)"""


@query(f"""WITH RECURSIVE {CYCLE_SQL}, w AS (SELECT graph, id, dep, 0 AS hop FROM n UNION ALL SELECT w.graph, w.id, n.dep, hop + 1 FROM w JOIN n ON n.graph = w.graph AND n.id = w.dep WHERE hop < 60)
SELECT DISTINCT graph, CAST(id AS VARCHAR) AS id FROM w WHERE hop = 60""")
def dag_cycle(spark, d):
    k, base = F.col("p_partkey"), F.col("p_partkey") % 50
    dep = F.when(base < 4, k - base + (base + 1) % 4).otherwise(k - 1 - k % 3)
    rows = table(spark, d, "part").select(F.call_function("div", k, F.lit(50).cast("bigint")).alias("graph"), k.cast("string").alias("id"), dep.cast("string").alias("dep"))
    return graph.stuck(rows.select("graph", "id"), rows)


@query("""SELECT o_orderstatus AS graph, count(*) AS n_nodes, CASE WHEN o_orderstatus = 'O' THEN count(*) ELSE 0 END AS n_stuck FROM orders GROUP BY 1""")
def dag_long_chains(spark, d):
    """All orders of a status as one chain of steps, each of which depends on the one before; the chain of 'O' is closed to a ring."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("graph"), F.col("o_orderkey").alias("id"))
    before = Window.partitionBy("graph").orderBy("id")
    linked = rows.withColumn("dep", F.lag("id").over(before))
    last = rows.filter("graph = 'O'").groupBy("graph").agg(F.min("id").alias("id"), F.max("id").alias("dep"))
    edges = linked.filter("dep IS NOT NULL").unionByName(last)
    held = graph.stuck(rows, edges).groupBy(F.col("graph").alias("_g")).agg(F.count(F.lit(1)).alias("n_stuck"))
    return rows.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes")).join(held, F.col("graph") == F.col("_g"), "left").select("graph", "n_nodes", F.coalesce("n_stuck", F.lit(0)).alias("n_stuck"))


# --- streams in a table


@query("""WITH x AS (SELECT user_id AS stream_id, event_type AS node_id, event_id AS pos, CAST(value AS BIGINT) // 20 + event_id // 50 AS seq FROM events),
b AS (SELECT *, coalesce(seq <= max(seq) OVER (PARTITION BY stream_id, node_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bad FROM x),
c AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM b)
SELECT stream_id, node_id, pos, CASE WHEN gone THEN 'cut' WHEN bad THEN 'error' ELSE 'ok' END AS status FROM c""")
def seq_discipline(spark, d):
    seq = F.call_function("div", F.bround("value", 0).cast("bigint"), F.lit(20).cast("bigint")) + F.call_function("div", F.col("event_id"), F.lit(50).cast("bigint"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_type").alias("node_id"), F.col("event_id").alias("pos"), seq.alias("seq"))
    return documents.in_sequence(rows, "stream_id", "node_id", "pos", "seq").select("stream_id", "node_id", "pos", "status")


@query("SELECT conv_id, role, count(*) AS n_parts, string_agg(coalesce(text, ''), '' ORDER BY turn) AS assembled FROM conversations GROUP BY 1, 2")
def partial_assembly(spark, d):
    return documents.assembled(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "text")


@query("""WITH a AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS whole, string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (conv_id % 3 <> 1 OR turn > 0) AS got FROM conversations GROUP BY 1)
SELECT conv_id, conv_id % 2 = 0 AS resumed, CASE WHEN conv_id % 2 = 0 THEN whole LIKE '%' AND suffix(whole, coalesce(got, '')) ELSE coalesce(got, '') = whole END AS bound FROM a""")
def partial_binding(spark, d):
    rows = table(spark, d, "conversations")
    whole = documents.assembled(rows, ["conv_id"], "turn", "text").select("conv_id", F.col("assembled").alias("whole"))
    got = documents.assembled(rows.filter("conv_id % 3 <> 1 OR turn > 0"), ["conv_id"], "turn", "text").select(F.col("conv_id").alias("_c"), "assembled")
    resumed = F.col("conv_id") % 2 == 0
    return whole.join(got, F.col("conv_id") == F.col("_c"), "left").select("conv_id", resumed.alias("resumed"), documents.bound(F.coalesce("assembled", F.lit("")), F.col("whole"), resumed).alias("bound"))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, replace(replace(to_base64(unhex(lpad(upper(to_hex(doc_id)), 8, '0') || upper(h))), '+', '-'), '/', '_') AS token, doc_id AS seq, doc_id % 3 <> 0 AS confirmed FROM h""")
def resume_token(spark, d):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"), S.resume_token(F.col("doc_id"), F.sha2(text.cast("binary"), 256)).alias("token"))
    received = F.when(F.col("doc_id") % 3 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))
    return rows.select("doc_id", "token", S.token_seq(F.col("token")).alias("seq"), S.token_confirms(F.col("token"), received).alias("confirmed"))


# --- exports and heuristics: a conversation is a document, its turns are nodes


def conversation_docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "conversations")
    model = F.element_at(F.array(*[F.lit(m) for m in ("Claude-x", "gpt-y", "Gemini-z", "llama-3", "other")]), (F.col("artifact_id") % 5 + 1).cast("int"))
    docs = rows.select(F.col("conv_id").alias("artifact_id")).distinct().withColumns({"model": model, "timestamp_ms": F.lit(1_700_000_000_000).cast("bigint") + F.col("artifact_id"), "signer": F.when(F.col("artifact_id") % 4 == 0, F.concat(F.lit("signer-of-conversation-"), F.col("artifact_id").cast("string")))})
    kind = F.when(F.col("turn") % 3 == 0, "text").when(F.col("turn") % 3 == 1, "tool_call").otherwise("tool_result")
    nodes = rows.select(F.col("conv_id").alias("artifact_id"), F.col("turn").alias("pos"), F.concat(F.lit("n"), F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.coalesce("text", F.lit("")).alias("text"), (1 / (F.col("turn") + 1)).alias("mean"), (F.col("conv_id") % 3 == 0).alias("is_error"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"))
    return docs, nodes


def trace_steps(nodes: DataFrame) -> DataFrame:
    """All turns but the first as steps of a trace."""
    return nodes.filter("pos > 0").withColumn("type", F.lit("inference"))


CONV_SQL = """d AS (SELECT DISTINCT conv_id AS artifact_id, ['Claude-x', 'gpt-y', 'Gemini-z', 'llama-3', 'other'][conv_id % 5 + 1] AS model, ['anthropic', 'openai', 'google_ai_studio', 'meta', 'custom'][conv_id % 5 + 1] AS system, 1700000000000 + conv_id AS timestamp_ms, CASE WHEN conv_id % 4 = 0 THEN 'signer-of-conversation-' || conv_id END AS signer FROM conversations),
n AS (SELECT conv_id AS artifact_id, turn AS pos, 'n' || turn AS id, ['text', 'tool_call', 'tool_result'][turn % 3 + 1] AS type, coalesce(text, '') AS text, 1.0::DOUBLE / (turn + 1) AS mean, conv_id % 3 = 0 AS is_error, 'c' || turn AS call_id FROM conversations)"""


@query(f"""WITH {CONV_SQL} SELECT artifact_id, 'gen_ai.chat' AS name, system, model, timestamp_ms * 1000000 AS start_ns, timestamp_ms * 1000000 + 1000000000 AS end_ns, round(avg(mean), 6) AS confidence_mean_avg, count(*) AS n_nodes,
coalesce(string_agg(call_id, ',' ORDER BY pos) FILTER (type <> 'text'), '') AS call_ids, CASE WHEN bool_or(type = 'tool_result' AND is_error) THEN 'ERROR' ELSE 'OK' END AS status FROM d JOIN n USING (artifact_id) GROUP BY ALL""")
def otel_spans(spark, d):
    return export.spans(*conversation_docs(spark, d)).withColumn("confidence_mean_avg", F.round("confidence_mean_avg", 6))


@query(f"""WITH {CONV_SQL} SELECT artifact_id, pos, CASE type WHEN 'tool_call' THEN 'gen_ai.tool.call' WHEN 'tool_result' THEN 'gen_ai.tool.result' ELSE 'gen_ai.content.completion' END AS name, timestamp_ms * 1000000 AS time_ns, type AS node_type, mean AS confidence_mean, text AS content FROM d JOIN n USING (artifact_id)
UNION ALL SELECT artifact_id, pos, 'sif.trace.step', timestamp_ms * 1000000, 'inference', mean, substr(text, 1, 256) FROM d JOIN n USING (artifact_id) WHERE pos > 0""")
def otel_events(spark, d):
    docs, nodes = conversation_docs(spark, d)
    return export.span_events(docs, nodes, trace_steps(nodes))


@query(f"""WITH {CONV_SQL}, x AS (SELECT *, 'inference/' || model || '/' || timestamp_ms AS activity, 'agent/' || model AS agent, 'signer/' || substr(signer, 1, 16) AS who, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM d), y AS (SELECT n.*, activity, agent FROM n JOIN x USING (artifact_id))
SELECT artifact_id, 'agent' AS relation, agent AS subject, NULL AS object, 'SoftwareAgent' AS detail FROM x UNION ALL SELECT artifact_id, 'agent', who, NULL, 'Person' FROM x WHERE signer IS NOT NULL UNION ALL SELECT artifact_id, 'activity', activity, NULL, iso FROM x
UNION ALL SELECT artifact_id, 'wasAssociatedWith', activity, agent, '' FROM x UNION ALL SELECT artifact_id, 'wasAssociatedWith', activity, who, '' FROM x WHERE signer IS NOT NULL UNION ALL SELECT artifact_id, 'entity', 'node/' || id, NULL, text FROM y
UNION ALL SELECT artifact_id, 'wasGeneratedBy', 'node/' || id, activity, '' FROM y UNION ALL SELECT artifact_id, 'wasAttributedTo', 'node/' || id, agent, '' FROM y UNION ALL SELECT artifact_id, 'wasDerivedFrom', 'step/' || id, 'step/n' || (pos - 1), '' FROM y WHERE pos > 0
UNION ALL SELECT artifact_id, 'entity', 'step/' || id, NULL, substr(text, 1, 512) FROM y WHERE pos > 0 UNION ALL SELECT artifact_id, 'activity', 'step_activity/' || id, NULL, iso FROM y JOIN x USING (artifact_id) WHERE pos > 0 UNION ALL SELECT artifact_id, 'wasGeneratedBy', 'step/' || id, 'step_activity/' || id, '' FROM y WHERE pos > 0""")
def prov_relations(spark, d):
    docs, nodes = conversation_docs(spark, d)
    deps = nodes.filter("pos > 0").select("artifact_id", "id", F.concat(F.lit("n"), (F.col("pos") - 1).cast("string")).alias("dep"))
    return export.relations(docs, nodes, deps, trace_steps(nodes))


@query("SELECT doc_id, CAST(coalesce(text, '') <> '' AS INT) + CAST(coalesce(lang, '') <> '' AS INT) + CAST(coalesce(source, '') <> '' AS INT) + CAST(n_chars IS NOT NULL AS INT) AS present, 4 AS asked, coalesce(text, '') <> '' AND coalesce(lang, '') <> '' AND coalesce(source, '') <> '' AND n_chars IS NOT NULL AS complete FROM documents")
def compliance_inspect(spark, d):
    return export.compliance(table(spark, d, "documents"), ["text", "lang", "source", "n_chars"], "doc_id")


def any_of(words: tuple[str, ...]) -> str:
    quoted = (w.replace("'", "''") for w in words)
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in quoted)


@query(f"""WITH m AS (SELECT doc_id, {any_of(S.LOW_WORDS)} AS l, {any_of(S.HIGH_WORDS)} AS h, {any_of(S.MEDIUM_WORDS)} AS k FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' It might be, perhaps.' WHEN 1 THEN ' Obviously sure.' WHEN 2 THEN ' It seems so.' ELSE '' END AS text FROM documents)),
v AS (SELECT doc_id, CAST(CASE WHEN h > l AND h > k THEN 0.88 WHEN l > h THEN 0.45 WHEN k > 0 THEN 0.70 ELSE 0.75 END AS DOUBLE) AS mean FROM m)
SELECT doc_id, mean, CAST(CASE mean WHEN 0.88 THEN 0.02 WHEN 0.45 THEN 0.08 ELSE 0.05 END AS DOUBLE) AS var, repeat('█', CAST(round_even(mean * 12, 0) AS INT)) || repeat('░', 12 - CAST(round_even(mean * 12, 0) AS INT)) AS bar FROM v""")
def hedge_bucket(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(i % 4 == 0, " It might be, perhaps.").when(i % 4 == 1, " Obviously sure.").when(i % 4 == 2, " It seems so.").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", S.hedged_mean(F.col("t")).cast("double").alias("mean"), S.hedged_variance(F.col("t")).cast("double").alias("var")).withColumn("bar", S.confidence_bar(F.col("mean")))


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'evidence' WHEN turn = n - 1 THEN 'conclusion' ELSE 'inference' END AS step_type FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def step_type(spark, d):
    rows = table(spark, d, "conversations")
    n = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, F.col("conv_id") == F.col("_c")).select("conv_id", "turn", S.step_type(F.col("turn"), F.col("n")).alias("step_type"))


@query("SELECT source, lang, avg(n_chars) AS avg_chars, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def grouping_sets(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT source, lang, avg(n_chars) AS avg_chars, count(*) AS n FROM _documents GROUP BY GROUPING SETS ((source), (lang), ())")


@query("""SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 3 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS parsed, epoch_us(ts) // 1000 * 1000000 AS ns FROM events""")
def time_formats(spark, d):
    ms = S.epoch_ms(F.col("ts"))
    iso = S.iso_ms(ms)
    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(iso)
    return table(spark, d, "events").select("event_id", iso.alias("iso"), ms.alias("ms"), S.parse_iso_ms(text).alias("parsed"), S.nanos(ms).alias("ns"))


@query("""SELECT s_name AS signer, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '=a=b' ELSE '' END AS opt, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'a=b' END AS value FROM supplier""")
def option_parse(spark, d):
    opt = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, "=a=b").otherwise(""))
    name, value = S.named_value(F.col("opt"))
    return table(spark, d, "supplier").select(F.col("s_name").alias("signer"), opt.alias("opt")).withColumns({"name": name, "value": value})


@query("SELECT p_partkey, CAST(p_partkey % 256 AS BIGINT) & 1 <> 0 AS provenance, CAST(p_partkey % 256 AS BIGINT) & 4 <> 0 AS trace, CAST(p_partkey % 256 AS BIGINT) & 64 <> 0 AS multisig, CAST(p_partkey % 256 AS BIGINT) & 128 <> 0 AS streaming FROM part")
def flag_bits(spark, d):
    return table(spark, d, "part").select("p_partkey", *[S.flag(F.col("p_partkey") % 256, n).alias(n) for n in ("provenance", "trace", "multisig", "streaming")])


@query("""SELECT l_orderkey AS graph, count(*) AS n, CASE WHEN count(*) > 3 THEN array_to_string(list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber, l_partkey)[1:3], ', ') || ' … and ' || (count(*) - 3) || ' more' ELSE array_to_string(list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber, l_partkey), ', ') END AS ids FROM lineitem GROUP BY 1""")
def short_lists(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph")).agg(F.count(F.lit(1)).alias("n"), ids.alias("all")).select("graph", "n", S.short_list(F.col("all"), 3).alias("ids"))


@query("""SELECT event_id, value / 500 AS mean, value / 1000 AS var, (value / 500 BETWEEN 0 AND 1) AND CASE WHEN event_id % 7 = 0 THEN false ELSE true END AS ok FROM events""")
def distribution_ranges(spark, d):
    mean, var = F.col("value") / 500, F.col("value") / 1000
    low, high = F.when(F.col("event_id") % 7 == 0, 0.9).otherwise(0.1), F.lit(0.5)
    return table(spark, d, "events").select("event_id", mean.alias("mean"), var.alias("var"), metrics.distribution_ok(mean, var, low, high).alias("ok"))


# --- event time

FIGURES = ("count(1) AS n", "round(sum(value), 4) AS total")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end FROM events GROUP BY 1, 4")
def metrics_tumbling(spark, d):
    return ntz(windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [*map(F.expr, FIGURES)]), "window_start", "window_end")


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, window_start, window_start + INTERVAL 1 HOUR AS window_end FROM w GROUP BY event_type, window_start""")
def metrics_sliding(spark, d):
    return ntz(windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [*map(F.expr, FIGURES)], slide="30 minutes"), "window_start", "window_end")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end FROM s GROUP BY user_id, k""")
def metrics_sessions(spark, d):
    return ntz(windows.sessions(table(spark, d, "events"), "ts", "2 hours", ["user_id"], [*map(F.expr, FIGURES)]), "session_start", "session_end")


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query()
def distinct_signers_approx(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_suppkey").alias("signers"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))
