"""Queries over real artifacts, built from rows: a conversation is an artifact, its turns are nodes."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.codec import artifact as A
from provspark.codec import ed25519
from provspark.operators import policy
from provspark.operators.shared import cut
from provspark.plans.registry import query, table
from provspark.sources import artifacts as S
from provspark.sources import governance
from provspark.streaming import artifacts as streams

#: Keys for these queries only, from public names.
SEEDS = {base64.b64encode(ed25519.public_key(s)).decode(): s for s in (hashlib.sha256(f"query key {i}".encode()).digest() for i in range(3))}
SIGNERS = sorted(SEEDS)


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """conv_id and nodes: a conversation's turns, each of which refers to the one before."""
    rows = table(spark, d, "conversations")
    node = F.struct(F.col("turn").alias("o"), F.concat(F.lit("n"), F.col("turn")).alias("id"), F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("value"), (1 / (F.col("turn") + 1)).alias("mean"), F.when(F.col("turn") > 0, F.array(F.concat(F.lit("n"), F.col("turn") - 1))).alias("refs"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def built(spark: SparkSession, d: str) -> DataFrame:
    """(artifact_id, content): conversations, of which those with an even id are signed, and every sixth is broken."""
    docs, i = documents_of(spark, d), F.col("conv_id")
    keys = F.array(*[F.lit(s) for s in SIGNERS])
    signers = F.when(i % 2 == 0, F.when(i % 4 == 0, F.slice(keys, 1, 2)).otherwise(F.slice(keys, 3, 1))).otherwise(F.array().cast("array<string>"))
    provenance = F.struct(F.lit("model").alias("source_model"), i.alias("timestamp_ms"), F.concat(F.lit("nonce"), i).alias("nonce"))
    made = S.simple_documents(docs.select(i.cast("string").alias("artifact_id"), "nodes", provenance.alias("provenance"), signers.alias("signers")), SEEDS)
    return made.withColumn("content", F.when(F.col("artifact_id").cast("bigint") % 6 == 5, F.concat(F.substring("content", 1, 40), F.unhex(F.lit("ff")), F.expr("substring(content, 42)"))).otherwise(F.col("content")))


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, CASE WHEN conv_id % 6 = 5 THEN 'INVALID' WHEN conv_id % 2 = 1 THEN 'UNSIGNED' ELSE 'VALID' END AS trust_status, CASE WHEN conv_id % 6 = 5 OR conv_id % 2 = 1 THEN 0 WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END AS n_signatures,
CASE WHEN conv_id % 6 = 5 THEN 'checksum' ELSE '' END AS error_class, CASE WHEN conv_id % 6 = 5 THEN 1 WHEN conv_id % 2 = 1 THEN 2 ELSE 0 END AS exit_code FROM (SELECT DISTINCT conv_id FROM conversations)""")
def trust_report(spark, d):
    return S.trust_report(built(spark, d), "artifact_id", "content").select("artifact_id", "trust_status", "n_signatures", "error_class", "exit_code")


#: Signers by name, whose keys are pinned; bob's pinned key is another's, and nobody pins carol's.
NAMED = {n: hashlib.sha256(f"key of {n}".encode()).digest() for n in ("alice", "bob", "carol", "clock", "stranger")}
PUBLIC = {n: base64.b64encode(ed25519.public_key(s)).decode() for n, s in NAMED.items()}


def pinned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, pinned keys, revocation statements and keys of time authorities.

    By conv_id modulo 8: signed by 0 alice; 2 alice, who revokes it; 4 bob; 6 a self-described key, and alice revokes it, who didn't
    sign it; 1 nobody; 3 carol; 5 a self-described key that revokes it; 7 alice, with a revocation that another key signed in her name.
    """
    docs, i = documents_of(spark, d), F.col("conv_id")
    own = SIGNERS[0]
    pick = lambda k, *names: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (k % len(names) + 1).cast("int"))
    signer = pick(i, "alice", None, "alice", "carol", "bob", own, own, "alice")
    made = simple(docs.select(i.cast("string").alias("artifact_id"), "nodes", F.struct(F.lit("model").alias("source_model"), i.alias("timestamp_ms")).alias("provenance"), F.when(signer.isNotNull(), F.array(signer)).alias("signers")))
    authority = pick(F.col("artifact_id").cast("bigint"), None, "clock", "stranger")
    files = cut(S.timestamped(made.withColumns({"authority": F.when(F.col("artifact_id").cast("bigint") % 8 != 1, authority), "time_ms": F.lit(5)}), NAMED))
    told = files.withColumns({"signer": pick(F.col("artifact_id").cast("bigint"), None, None, "alice", None, None, own, "alice", "alice"), "issued_ms": F.col("artifact_id"), "reason": F.lit("retracted")})
    seven = F.col("artifact_id").cast("bigint") % 8 == 7
    statements = S.revocations(told.filter(~seven), NAMED | SEEDS).unionByName(S.revocations(told.filter(seven), {"alice": NAMED["carol"]}))
    table_of = lambda names, column: spark.createDataFrame([(n, PUBLIC[k]) for n, k in names.items()], f"{column} string, key_b64 string")
    return files, table_of({"alice": "alice", "bob": "carol"}, "signer"), statements.unionByName(statements.limit(5)), table_of({"clock": "clock"}, "authority")


def simple(rows: DataFrame) -> DataFrame:
    return S.simple_documents(rows, NAMED | SEEDS)


PINNED_SQL = """c AS (SELECT DISTINCT conv_id, conv_id % 8 AS k, conv_id % 3 AS t FROM conversations),
p AS (SELECT CAST(conv_id AS VARCHAR) AS artifact_id, ['VALID', 'UNSIGNED', 'REVOKED', 'UNVERIFIABLE', 'INVALID', 'REVOKED', 'VALID', 'VALID'][k + 1] AS trust_status, CASE WHEN k IN (2, 5) THEN 1 ELSE 0 END AS revocations_applied, CASE WHEN k IN (6, 7) THEN 1 ELSE 0 END AS forged_revocations,
CASE WHEN k = 1 OR t = 0 THEN 'absent' WHEN t = 1 THEN 'verified' ELSE 'unverified' END AS timestamp_status, [CASE WHEN k IN (0, 2, 4, 7) THEN 'pinned' WHEN k <> 1 THEN 'resolved' END] AS basis, k FROM c)"""


@query(f"""WITH {PINNED_SQL} SELECT artifact_id, trust_status, revocations_applied, forged_revocations, timestamp_status, basis[1] AS basis, CASE trust_status WHEN 'VALID' THEN 0 WHEN 'UNSIGNED' THEN 2 ELSE 1 END AS exit_code FROM p""")
def trust_report_pinned(spark, d):
    files, known, statements, clocks = pinned(spark, d)
    got = S.trust_report(files, "artifact_id", "content", known, statements, tsa_keys=clocks)
    return got.select("artifact_id", "trust_status", "revocations_applied", "forged_revocations", "timestamp_status", F.get("signatures", F.lit(0))["basis"].alias("basis"), "exit_code")


@query(f"""WITH {PINNED_SQL} SELECT artifact_id, CASE WHEN trust_status = 'VALID' THEN 'UNVERIFIABLE' ELSE trust_status END AS trust_status, forged_revocations + 2 AS forged_revocations FROM p""")
def trust_report_unreadable_source(spark, d):
    files, known, statements, _ = pinned(spark, d)
    return S.trust_report(files, "artifact_id", "content", known, statements, malformed=2, source_failed=True).select("artifact_id", "trust_status", "forged_revocations")


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, k AS failure_code FROM (SELECT DISTINCT conv_id, [NULL, 'UNSIGNED', NULL, 'UNTRUSTED', 'SIGNATURE_INVALID', 'KEY_REVOKED', 'KEY_REVOKED', NULL][conv_id % 8 + 1] AS k FROM conversations)""")
def keystore_gate(spark, d):
    files, known, _, _ = pinned(spark, d)
    store = known.unionByName(spark.createDataFrame([(SIGNERS[0], SIGNERS[0])], "signer string, key_b64 string"))
    rows = S.keystore_checked(S.assessed(files, "artifact_id", "content", store), spark.createDataFrame([(SIGNERS[0],)], "signer string"))
    return policy.evaluate(rows, policy.Policy(require_signature=True, check_keys=True)).select("artifact_id", "failure_code")


#: Events of conversations: a turn is an event, which names the turn before as its parent; some are made wrong.
ACTORS = {n: hashlib.sha256(n.encode()).digest() for n in (*(f"actor/{t}" for t in policy.EVENT_TYPES), "actor/old", "actor/unknown", "actor/forged", "actor/other")}


@query("""WITH c AS (SELECT conv_id, turn, conv_id % 7 AS k FROM conversations),
o AS (SELECT *, CASE WHEN k = 3 AND turn = 1 THEN 'invalid_signature' WHEN k = 5 AND turn = 2 THEN 'unknown_signer' WHEN k = 1 AND turn = 1 THEN 'event_role_mismatch' WHEN k = 6 AND turn = 3 THEN 'revoked_signer' WHEN k = 2 AND turn = 0 THEN 'provenance_timestamp_mismatch' WHEN k = 4 AND turn = 2 THEN 'unauthorized_role' END AS own FROM c),
p AS (SELECT *, min(turn) FILTER (own IS NOT NULL) OVER (PARTITION BY conv_id) AS first FROM o)
SELECT conv_id AS chain_id, turn AS pos, 'e' || conv_id || '-' || turn AS event_id, r = 'verified' AS valid, r AS reason FROM (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN turn % 6 = 0 AND turn > 0 THEN 'invalid_root' WHEN turn > least(coalesce(first, 100), 6) THEN 'missing_parent' ELSE 'verified' END AS r FROM p)""")
def governance_artifacts(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    k, kind = c % 7, F.element_at(F.array(*[F.lit(x) for x in policy.EVENT_TYPES]), (t % 6 + 1).cast("int"))
    name = lambda turn: F.concat(F.lit("e"), c.cast("string"), F.lit("-"), turn.cast("string"))
    actor = F.when((k == 3) & (t == 1), "actor/forged").when((k == 5) & (t == 2), "actor/unknown").when((k == 6) & (t == 3), "actor/old").when((k == 4) & (t == 2), "actor/other").otherwise(F.concat(F.lit("actor/"), kind))
    rows = table(spark, d, "conversations").select(
        F.concat_ws("/", c.cast("string"), t.cast("string")).alias("artifact_id"), kind.alias("event_type"), name(t).alias("event_id"), (t + 5).alias("timestamp_ms"), actor.alias("actor"), F.to_json(F.struct(F.col("role").alias("by"))).alias("payload"),
        F.when(t > 0, F.array(name(t - 1))).alias("parent_ids"), F.lit("policy").alias("policy_id"), F.lit("credential").alias("credential_ref"), F.when((k == 1) & (t == 1), "model_provider").alias("role"), F.when((k == 2) & (t == 0), F.lit(1).cast("bigint")).alias("provenance_ms"),
    )
    public = {n: base64.b64encode(ed25519.public_key(s)).decode() for n, s in ACTORS.items() if n != "actor/unknown"}
    known = spark.createDataFrame([*(public | {"actor/forged": public["actor/other"]}).items()], "signer string, key_b64 string")
    grants = spark.createDataFrame([(r, f"actor/{t}") for t, r in policy.EVENT_ROLES.items()] + [(r, "actor/old") for r in policy.EVENT_ROLES.values()], "role string, signer string")
    checked = governance.checked_events(S.assessed(governance.signed_events(rows, ACTORS), "artifact_id", "content", known), grants, spark.createDataFrame([("actor/old",)], "signer string"))
    at = F.split("artifact_id", "/")
    placed = policy.event_reasons(checked).withColumns({"chain_id": at[0].cast("bigint"), "pos": at[1].cast("bigint")})
    return policy.governed(placed).select("chain_id", "pos", "event_id", "valid", "reason")


@query("SELECT CAST(conv_id AS VARCHAR) AS artifact_id, conv_id % 6 <> 5 AS ok, CASE WHEN conv_id % 6 <> 5 THEN count(*) END AS n_nodes, CASE WHEN conv_id % 6 <> 5 THEN round(avg(1.0::DOUBLE / (turn + 1)), 6) END AS confidence FROM conversations GROUP BY conv_id")
def artifact_roundtrip(spark, d):
    rows = S.decoded(built(spark, d), "artifact_id", "content")
    mean = F.aggregate("payload", F.lit(0.0), lambda s, n: s + n["confidence"]["mean"]) / F.size("payload")
    return rows.select("artifact_id", F.col("decode.ok").alias("ok"), F.when(F.col("payload").isNotNull(), F.size("payload").cast("bigint")).alias("n_nodes"), F.round(mean, 6).alias("confidence"))


@query("SELECT CAST(conv_id AS VARCHAR) AS artifact_id, 'n' || turn AS id, coalesce(text, '') AS value FROM conversations WHERE conv_id % 6 <> 5")
def artifact_nodes(spark, d):
    rows = S.decoded(built(spark, d), "artifact_id", "content").filter("decode.ok")
    return rows.select("artifact_id", F.explode("payload").alias("n")).select("artifact_id", "n.id", F.from_json(F.concat(F.lit('{"v":'), F.col("n.value"), F.lit("}")), "v string")["v"].alias("value"))


@query("SELECT CAST(conv_id AS VARCHAR) AS artifact_id, conv_id % 2 = 0 AS stable FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 6 <> 5)")
def artifact_digest_stable(spark, d):
    """Whether a chunk that is attached later leaves the digest as it was: in signed artifacts it does, an unsigned one's digest covers it."""
    schema = pa.schema([("artifact_id", pa.string()), ("stable", pa.bool_())])

    def run(batches):
        for b in batches:
            out = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                more = A.attached(data, "TIMESTAMP", {"authority": "tsa", "time_ms": 1, "token": b""})
                out.append({"artifact_id": k, "stable": A.digest(more) == A.digest(data) and A.decode(more)["timestamp_anchor"]["time_ms"] == 1})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return built(spark, d).filter("CAST(artifact_id AS BIGINT) % 6 <> 5").mapInArrow(run, "artifact_id string, stable boolean")


@query("SELECT error_class, count(*) AS n FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 6 = 5 THEN 'checksum' ELSE '' END AS error_class FROM conversations) GROUP BY 1")
def tamper_detect(spark, d):
    return S.decoded(built(spark, d), "artifact_id", "content").groupBy(F.col("decode.error_class").alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, name FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 6 <> 5), (SELECT unnest(['HEADER', 'PROVENANCE', 'PAYLOAD', 'CHECKSUM', 'SIGNATURE', 'MULTISIG']) AS name)
WHERE name IN ('HEADER', 'PROVENANCE', 'PAYLOAD', 'CHECKSUM') OR (name = 'MULTISIG' AND conv_id % 4 = 0) OR (name = 'SIGNATURE' AND conv_id % 4 = 2)""")
def artifact_chunks(spark, d):
    return S.chunk_rows(built(spark, d).filter("CAST(artifact_id AS BIGINT) % 6 <> 5"), "artifact_id").select("artifact_id", "name")


@query("SELECT CAST(conv_id AS VARCHAR) AS artifact_id, CASE WHEN conv_id % 6 = 5 THEN 'INVALID' WHEN conv_id % 2 = 1 THEN 'UNSIGNED' ELSE 'VALID' END AS trust_status, CASE WHEN conv_id % 6 = 5 THEN 0 ELSE 2 END AS present, conv_id < 0 AS complete FROM (SELECT DISTINCT conv_id FROM conversations)")
def audit_report(spark, d):
    return S.audit(built(spark, d), "artifact_id", "content", ["source_model", "nonce", "risk_tier"]).select("artifact_id", "trust_status", "present", "complete")


@query("SELECT CAST(conv_id AS VARCHAR) AS artifact_id, conv_id % 4 = 0 AS accepted, CASE WHEN conv_id % 6 = 5 THEN 'invalid' WHEN conv_id % 2 = 1 THEN 'unsigned' WHEN conv_id % 4 = 0 THEN 'accepted' ELSE 'unexpected_signer' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations)")
def cross_org_handoff(spark, d):
    return S.handoff(built(spark, d), "artifact_id", "content", SIGNERS[0])


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS stream_id, 'opened' AS event, NULL::BIGINT AS seq FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT CAST(conv_id AS VARCHAR), 'partial_text', turn FROM t WHERE conv_id % 5 <> 0 OR turn = 0 UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), CASE WHEN conv_id % 5 = 0 AND n > 1 THEN 'error' ELSE 'verified' END, NULL FROM t""")
def stream_events(spark, d):
    rows = table(spark, d, "conversations")
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))

    def run(batches):
        from provspark.codec.stream import written

        for b in batches:
            out = []
            for c, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                node = {"id": "main", "type": "text", "value": "".join(p["text"] for p in ps), "confidence": {"mean": 1.0, "var": 0.0, "shape": "point", "semantics": "epistemic"}, "refs": []}
                seqs = [p["turn"] if c % 5 else ps[0]["turn"] for p in ps]  # every fifth repeats its first number
                out.append({"path": str(c), "content": written({"payload": [node]}, [("main", s, p["text"]) for s, p in zip(seqs, ps)])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return streams.replayed(parts.mapInArrow(run, "path string, content binary")).select("stream_id", "event", "seq")
