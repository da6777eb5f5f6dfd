"""Policy gate: the first rule that a document breaks names its failure."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """None: not asked for."""

    require_signature: bool = False
    check_keys: bool = False
    check_crl: bool = False
    allowed_models: DataFrame | None = None  # (model)
    trusted_signers: DataFrame | None = None  # (signer)
    minimum_confidence: float | None = None


def evaluate(docs: DataFrame, policy: Policy, crl: DataFrame | None = None) -> DataFrame:
    """docs with failure_code, null if they pass, and allowed.

    docs: artifact_id, decode_error ('' if it decodes), signer (null if unsigned), key_status ('ok', 'revoked', 'unknown',
    'invalid'; null or anything else counts as invalid), model, confidence (its average, null without nodes). crl: (signer).
    A policy that asks for a CRL without one is an error. Lists are joined, so they can be of any size; the optimizer broadcasts them if they are small.
    """
    if policy.check_crl and crl is None:
        raise ValueError("the policy asks for a revocation list, and there is none")
    out = docs
    rules: list[tuple[Column, str]] = [
        (F.col("decode_error").contains("Checksum"), "TAMPERED"),
        (F.col("decode_error") != "", "FORMAT"),
    ]
    if policy.require_signature or policy.check_keys:
        rules.append((F.col("signer").isNull(), "UNSIGNED"))
    if policy.check_keys:
        bad = F.col("signer").isNotNull()
        rules += [(bad & (F.col("key_status") == s), c) for s, c in (("revoked", "KEY_REVOKED"), ("unknown", "UNTRUSTED"))]
        # Whatever isn't known to be good is bad.
        rules.append((bad & ~F.col("key_status").eqNullSafe(F.lit("ok")), "SIGNATURE_INVALID"))
    if policy.check_crl:
        out = listed(out, crl, "signer", "_crl")
        rules.append((F.col("_crl"), "KEY_REVOKED"))
    if policy.allowed_models is not None:
        out = listed(out, policy.allowed_models, "model", "_model")
        rules.append((~F.col("_model"), "POLICY_VIOLATION"))
    if policy.trusted_signers is not None:
        out = listed(out, policy.trusted_signers, "signer", "_trusted")
        rules.append((~F.col("_trusted"), "POLICY_VIOLATION"))
    if policy.minimum_confidence is not None:
        rules.append((F.coalesce("confidence", F.lit(1.0)) < policy.minimum_confidence, "POLICY_VIOLATION"))
    code = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        code = F.when(broken, name).otherwise(code)
    return out.withColumns({"failure_code": code, "allowed": code.isNull()}).drop("_crl", "_model", "_trusted")


def listed(df: DataFrame, names: DataFrame, column: str, flag: str) -> DataFrame:
    one = names.select(F.col(column).alias("_name")).distinct()
    return df.join(one, F.col(column) == F.col("_name"), "left").withColumn(flag, F.col("_name").isNotNull()).drop("_name")


def failure_records(judged: DataFrame, rule: str = "default_policy") -> DataFrame:
    """Records of blocked documents: a node fpr_status of five fields, with the document's own model kept."""
    blocked = judged.filter("NOT allowed")
    value = F.to_json(F.struct(F.lit("invalid").alias("status"), "failure_code", F.lit(rule).alias("rule_triggered"), F.lit("BLOCKED").alias("action")))
    return blocked.select("artifact_id", F.lit("fpr_status").alias("node_id"), F.lit("verification_failure").alias("node_type"), value.alias("value"), F.lit(1.0).alias("confidence_mean"), F.col("model").alias("source_model"))


#: Event kinds in their order, and the role that may sign each.
EVENT_ROLES: Mapping[str, str] = {"Decision": "model_provider", "Evidence": "evidence_service", "PolicyEvaluation": "policy_engine", "Review": "human_reviewer", "Action": "action_service", "Outcome": "outcome_source"}
EVENT_TYPES: Sequence[str] = tuple(EVENT_ROLES)


def event_reasons(events: DataFrame, expected_signer: Column | None = None) -> DataFrame:
    """Governance events with reason and valid: the first of the ordered checks that fails, or verified.

    events: has_signature, signature_signer, key_known, key_revoked, signature_ok, event_ok, signer_id, actor, has_provenance,
    source_model, provenance_ms, timestamp_ms, event_type, claimed_role, role_listed, role_granted, other_roles_ok.
    """
    c = F.col
    role = F.lit(None).cast("string")
    for t, r in EVENT_ROLES.items():
        role = F.when(c("event_type") == t, r).otherwise(role)
    empty = lambda x: x.isNull() | (x == "")
    differs = lambda a, b: ~a.eqNullSafe(b)
    checks = [
        (~c("has_signature"), "missing_signature"),
        (empty(c("signature_signer")), "missing_signer_binding"),
        (~c("key_known"), "unknown_signer"),
        (~c("signature_ok"), "invalid_signature"),
        (c("key_revoked"), "revoked_signer"),
        (~c("event_ok"), "invalid_event"),
        (empty(c("signer_id")), "missing_signer_binding"),
        (differs(c("signature_signer"), c("signer_id")), "signer_mismatch"),
        (differs(c("actor"), c("signer_id")), "actor_signer_mismatch"),
        *([(differs(c("signer_id"), expected_signer), "expected_signer_mismatch")] if expected_signer is not None else []),
        (~c("has_provenance"), "missing_provenance"),
        (differs(c("source_model"), c("actor")), "provenance_actor_mismatch"),
        (differs(c("provenance_ms"), c("timestamp_ms")), "provenance_timestamp_mismatch"),
        (differs(c("claimed_role"), role), "event_role_mismatch"),
        (~c("role_listed"), "role_authorization_missing"),
        (~c("role_granted") | ~c("other_roles_ok"), "unauthorized_role"),
    ]
    reason = F.lit("verified")
    for bad, name in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return events.withColumns({"reason": reason, "valid": reason == "verified"})


def governed(events: DataFrame) -> DataFrame:
    """(chain_id, pos, event_id, event_type, parent_ids, valid, reason) with the topology of each chain enforced.

    A chain is folded in the order of pos, since an event that fails can't be a parent of a later one.
    Chains are spread over tasks and sorted within them; a task holds one chain's valid events at a time.
    """
    columns = ["chain_id", "pos", "event_id", "event_type", "parent_ids", "valid", "reason"]
    rows = events.select(*columns)
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", "pos").mapInArrow(fold_chains, rows.schema)


def fold_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {t: i for i, t in enumerate(EVENT_TYPES)}
    chain, kept, decided = object(), {}, False
    for b in batches:
        reasons = []
        for own, event_id, kind, parents, valid, reason in zip(*(b.column(n).to_pylist() for n in ("chain_id", "event_id", "event_type", "parent_ids", "valid", "reason"))):
            if own != chain:
                chain, kept, decided = own, {}, False
            if valid:
                reason = misplaced(event_id, kind, parents or [], kept, decided, order)
                if reason == "verified":
                    kept[event_id], decided = kind, decided or kind == "Decision"
            reasons.append(reason)
        new = {"reason": pa.array(reasons, b.schema.field("reason").type), "valid": pa.array([r == "verified" for r in reasons])}
        yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)


def misplaced(event_id: str, kind: str, parents: list[str], kept: Mapping[str, str], decided: bool, order: Mapping[str, int]) -> str:
    """What is wrong with a valid event's place after the kept ones, or verified."""
    if event_id in kept:
        return "duplicate_event_id"
    if kind == "Decision" and (parents or decided) or kind != "Decision" and not parents:
        return "invalid_root"
    if len(set(parents)) < len(parents):
        return "duplicate_parent"
    if not all(p in kept for p in parents):
        return "missing_parent"
    return "parent_order" if any(order[kept[p]] >= order[kind] for p in parents) else "verified"


def chain_summary(decisions: DataFrame) -> DataFrame:
    """By chain: events, failures, trust_valid and complete (exactly one valid event of each type)."""
    ones = [F.count_if(F.col("valid") & (F.col("event_type") == t)) == 1 for t in EVENT_TYPES]
    complete = ones[0]
    for x in ones[1:]:
        complete = complete & x
    by = decisions.groupBy("chain_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("valid")).alias("failures"), complete.alias("_one"))
    return by.withColumns({"trust_valid": F.col("failures") == 0, "complete": (F.col("failures") == 0) & F.col("_one")}).drop("_one")
