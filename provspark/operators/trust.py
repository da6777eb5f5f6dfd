"""Trust over tables: signature states to document states, revocations, references and time anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.scalars import is_cross, ref_document, ref_node

STATEMENT = ("artifact_digest", "signer", "issued_ms", "reason", "signature")


def document_status(signatures: Column) -> Column:
    """Trust status of an array of signature states ('valid', 'invalid', 'unverifiable'): any invalid wins, then all valid."""
    return (
        F.when(F.size(signatures) <= 0, "UNSIGNED")
        .when(F.exists(signatures, lambda s: s == "invalid"), "INVALID")
        .when(F.forall(signatures, lambda s: s == "valid"), "VALID")
        .otherwise("UNVERIFIABLE")
    )


def rolled_up(docs: DataFrame, signatures: DataFrame, key: str = "artifact_id") -> DataFrame:
    """docs with n_signatures and trust_status, from signature rows (key, status)."""
    by = signatures.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n_signatures"), F.bool_or(F.col("status") == "invalid").alias("_bad"), F.bool_and(F.col("status") == "valid").alias("_good"))
    status = F.when(F.col("_k").isNull(), "UNSIGNED").when(F.col("_bad"), "INVALID").when(F.col("_good"), "VALID").otherwise("UNVERIFIABLE")
    return docs.join(by, F.col(key) == F.col("_k"), "left").withColumns({"n_signatures": F.coalesce("n_signatures", F.lit(0)), "trust_status": status}).drop("_k", "_bad", "_good")


def merged_statements(*sources: DataFrame) -> DataFrame:
    """Revocation statements of all sources, each different one once."""
    out = sources[0].select(*STATEMENT)
    for s in sources[1:]:
        out = out.unionByName(s.select(*STATEMENT))
    return out.dropDuplicates(list(STATEMENT))


def revoked(docs: DataFrame, statements: DataFrame, authentic: Column, source_failed: Column | None = None) -> DataFrame:
    """docs (artifact_digest, signers, trust_status) with revocations_applied, forged_revocations and the lowered status.

    authentic: whether a statement's own signature verifies. A statement applies if it is authentic and its
    signer is one of the artifact's; statements on other artifacts count for nothing. Only VALID is
    lowered: to REVOKED, or to UNVERIFIABLE where a source of statements could not be read.
    """
    told = statements.withColumn("_ok", F.coalesce(authentic, F.lit(False))).select(F.col("artifact_digest").alias("_d"), F.col("signer").alias("_s"), "_ok")
    met = docs.select("artifact_digest", "signers").dropDuplicates(["artifact_digest"]).join(told, F.col("artifact_digest") == F.col("_d"))
    applies = F.col("_ok") & F.array_contains("signers", F.col("_s"))
    by = met.groupBy("_d").agg(F.count_if(applies).alias("_applied"), F.count_if(~applies).alias("_forged"))
    out = docs.join(by, F.col("artifact_digest") == F.col("_d"), "left")
    applied = F.coalesce("_applied", F.lit(0))
    lowered = F.when((F.col("trust_status") == "VALID") & (applied > 0), "REVOKED")
    if source_failed is not None:
        lowered = lowered.when((F.col("trust_status") == "VALID") & source_failed, "UNVERIFIABLE")
    return out.withColumns({"revocations_applied": applied, "forged_revocations": F.coalesce("_forged", F.lit(0)), "trust_status": F.coalesce(lowered, "trust_status")}).drop("_d", "_applied", "_forged")


def references(refs: DataFrame, bundle: DataFrame) -> DataFrame:
    """refs (…, ref) with kind, status, content_id and node_id; bundle is (content_id, node_id)."""
    have = bundle.select(F.col("content_id").alias("_c"), F.col("node_id").alias("_n")).distinct()
    own = refs.withColumns({"content_id": ref_document(F.col("ref")), "node_id": ref_node(F.col("ref"))})
    met = own.join(have, (F.col("content_id") == F.col("_c")) & (F.col("node_id") == F.col("_n")), "left")
    kind = F.when(is_cross(F.col("ref")), "cross-document").otherwise("local")
    status = F.when(~is_cross(F.col("ref")), "local").when(F.col("_c").isNotNull(), "resolved").otherwise("unresolved")
    return met.withColumns({"kind": kind, "status": status}).drop("_c", "_n")


def timestamp_status(anchors: DataFrame, tsa_keys: DataFrame, token_ok: Column) -> DataFrame:
    """Adds timestamp_status: absent without an authority, verified with a pinned key and a good token, else unverified."""
    keys = tsa_keys.select(F.col("authority").alias("_a")).distinct()
    met = anchors.join(keys, F.col("authority") == F.col("_a"), "left")
    return met.withColumn("timestamp_status", F.when(F.col("authority").isNull(), "absent").when(F.col("_a").isNotNull() & F.coalesce(token_ok, F.lit(False)), "verified").otherwise("unverified")).drop("_a")


def age_status(timestamp_ms: Column, now_ms: Column, max_age_ms: int, skew_ms: int = 5000) -> Column:
    """expired, post-dated, missing or ok for a signature of a given time."""
    age = now_ms - timestamp_ms
    return F.when(timestamp_ms.isNull(), "missing").when(age > max_age_ms, "expired").when(age < -skew_ms, "post-dated").otherwise("ok")


def exit_code(status: Column) -> Column:
    return F.when(status == "VALID", 0).when(status == "UNSIGNED", 2).otherwise(1)


def unrevoked(docs: DataFrame, revoked_keys: DataFrame, signer: str = "signer") -> DataFrame:
    """Documents whose signer isn't revoked."""
    return docs.join(revoked_keys.select(F.col("signer").alias("_r")), F.col(signer) == F.col("_r"), "left_anti")


def resolved_keys(signers: DataFrame, known: DataFrame, size: int = 32) -> DataFrame:
    """signers with key and basis: a pinned key if the id is known, usable or not, else the id itself if it is base64 of size bytes."""
    k = known.select(F.col("signer").alias("_s"), F.col("key_b64").alias("_b"))
    usable = lambda c: F.when(F.length(F.try_to_binary(c, F.lit("base64"))) == size, c)
    met = signers.join(k, F.col("signer") == F.col("_s"), "left")
    return met.withColumns({"key_b64": F.when(F.col("_s").isNotNull(), usable(F.col("_b"))).otherwise(usable(F.col("signer"))), "basis": F.when(F.col("_s").isNotNull(), "pinned").otherwise("resolved")}).drop("_s", "_b")


def role_checked(claims: DataFrame, grants: DataFrame) -> DataFrame:
    """claims (role, signer) with authorized: a role without grants is open to all."""
    roles = grants.select(F.col("role").alias("_role")).distinct()
    pairs = grants.select(F.col("role").alias("_r"), F.col("signer").alias("_s")).distinct()
    met = claims.join(roles, F.col("role") == F.col("_role"), "left").join(pairs, (F.col("role") == F.col("_r")) & (F.col("signer") == F.col("_s")), "left")
    return met.withColumn("authorized", F.col("_role").isNull() | F.col("_s").isNotNull()).drop("_role", "_r", "_s")
