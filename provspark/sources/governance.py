"""Governance events in artifacts: built and signed, and read back with what their verification needs.

An event is the one concept node of an artifact; its value names the profile, the event's fields and its signer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.codec import artifact as A
from provspark.codec import ed25519
from provspark.operators.policy import EVENT_ROLES, EVENT_TYPES

#: What marks an event's node.
PROFILE, NODE_TYPE = "spif-clinical-governance-v0", "concept"
TEXTS = ("event_id", "actor", "policy_id", "credential_ref")
CERTAIN = {"mean": 1.0, "var": 0.0, "shape": "point", "semantics": "epistemic"}
#: What is read of an event, whether or not all is in order.
EVENT = pa.struct([("ok", pa.bool_()), ("event_id", pa.string()), ("signer_id", pa.string()), ("event_type", pa.string()), ("actor", pa.string()), ("timestamp_ms", pa.int64()), ("parent_ids", pa.list_(pa.string())), ("policy_id", pa.string())])


def fault(value: Any, node_id: str, node_type: str) -> str:
    """What is wrong with an event's value, or ''."""
    if node_type != NODE_TYPE or not isinstance(value, dict) or value.get("profile") != PROFILE:
        return "no event"
    if value.get("event_type") not in EVENT_TYPES or not all(isinstance(value.get(n), str) and value[n] for n in TEXTS):
        return "a field is missing or of a wrong type"
    ms, parents = value.get("timestamp_ms"), value.get("parent_ids")
    if not isinstance(ms, int) or not 0 <= ms < 1 << 63 or not isinstance(value.get("payload"), dict):
        return "a field is missing or of a wrong type"
    if not isinstance(parents, list) or not all(isinstance(p, str) and p for p in parents):
        return "parents aren't ids"
    return "" if value["event_id"] == node_id else "the node has another id"


def event_of(doc: dict) -> dict | None:
    """The event of a decoded artifact in the shape of EVENT; null without a single node that has a map."""
    nodes = doc.get("payload") or []
    if len(nodes) != 1 or not isinstance(nodes[0]["value"], dict):
        return None
    value = nodes[0]["value"]
    text = lambda n: x if isinstance(x := value.get(n, ""), str) else ""
    out = {n: text(n) for n in ("event_id", "signer_id", "event_type", "actor", "policy_id")} | {"ok": not fault(value, nodes[0]["id"], nodes[0]["type"])}
    return out | ({"timestamp_ms": int(value["timestamp_ms"]), "parent_ids": value["parent_ids"]} if out["ok"] else {"timestamp_ms": None, "parent_ids": None})


def signed_events(rows: DataFrame, seeds: dict[str, bytes]) -> DataFrame:
    """(artifact_id, content): events, each signed by its actor.

    rows: artifact_id, event_type, event_id, timestamp_ms, actor, payload (JSON), parent_ids, policy_id, credential_ref; and, where
    they are there, role and provenance_ms, which claim something else than the event says. seeds: private keys by actor.
    """
    schema = pa.schema([("artifact_id", pa.string()), ("content", pa.binary())])

    def build(r: dict) -> bytes:
        value = {"profile": PROFILE, "event_type": r["event_type"], "timestamp_ms": r["timestamp_ms"], "payload": json.loads(r["payload"] or "{}"), "parent_ids": r["parent_ids"] or [], "signer_id": r["actor"]} | {n: r[n] for n in TEXTS}
        if wrong := fault(value, r["event_id"], NODE_TYPE):
            raise ValueError(wrong)
        given = lambda n, otherwise: otherwise if r.get(n) is None else r[n]
        doc = {
            "payload": [{"id": r["event_id"], "type": NODE_TYPE, "value": value, "confidence": CERTAIN, "refs": []}],
            "provenance": {"source_model": r["actor"], "timestamp_ms": given("provenance_ms", r["timestamp_ms"])},
            "signer_roles": {r["actor"]: given("role", EVENT_ROLES[r["event_type"]])},
        }
        return A.signed(doc, [(r["actor"], lambda body: ed25519.sign(seeds[r["actor"]], body))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"artifact_id": r["artifact_id"], "content": build(r)} for r in b.to_pylist()], schema=schema)

    return rows.mapInArrow(run, "artifact_id string, content binary")


def checked_events(rows: DataFrame, grants: DataFrame, revoked: DataFrame) -> DataFrame:
    """The columns that policy.event_reasons() takes, for artifacts.assessed() rows: with the keys there as the known ones.

    grants: (role, signer); a role without any is open where a document claims it, but events need one. revoked: (signer).
    """
    from provspark.operators import trust

    first = F.get("checked", F.lit(0))
    own = rows.filter("decode.ok").select(
        "artifact_id", ((F.size("signatures") == 1) & (F.get("signatures", F.lit(0))["slot"] == "single")).alias("has_signature"), first["signer"].alias("signature_signer"),
        F.coalesce(first["basis"] == "pinned", F.lit(False)).alias("key_known"), F.coalesce((first["status"] == "valid") & (first["algorithm"] == "ed25519"), F.lit(False)).alias("signature_ok"),
        F.coalesce(F.col("event.ok"), F.lit(False)).alias("event_ok"), "event.event_id", "event.signer_id", "event.event_type", "event.actor", "event.timestamp_ms", "event.parent_ids",
        F.col("provenance").isNotNull().alias("has_provenance"), "provenance.source_model", F.col("provenance.timestamp_ms").alias("provenance_ms"), "roles",
    )
    claims = own.select("artifact_id", F.explode("roles").alias("r")).select("artifact_id", "r.signer", "r.role", F.lit(True).alias("claimed"))
    # Roles may be claimed only by who signs.
    claims = claims.join(own.select(F.col("artifact_id").alias("_a"), F.col("signature_signer").alias("_s")), (F.col("artifact_id") == F.col("_a")) & (F.col("signer") == F.col("_s")), "left")
    ok = trust.role_checked(claims.withColumn("own", F.col("_a").isNotNull()).drop("_a", "_s"), grants).groupBy(F.col("artifact_id").alias("_a")).agg(F.bool_and(F.col("authorized") & F.col("own")).alias("_roles_ok"))
    role = F.lit(None).cast("string")
    for t, r in EVENT_ROLES.items():
        role = F.when(F.col("event_type") == t, r).otherwise(role)
    listed = grants.select(F.col("role").alias("_r")).distinct()
    granted = grants.select(F.col("role").alias("_g"), F.col("signer").alias("_s")).distinct()
    out = own.withColumns({"_role": role, "claimed_role": F.get(F.filter("roles", lambda x: x["signer"] == F.col("signer_id")), F.lit(0))["role"]})
    out = out.join(listed, F.col("_role") == F.col("_r"), "left").join(granted, (F.col("_role") == F.col("_g")) & (F.col("signer_id") == F.col("_s")), "left").join(ok, F.col("artifact_id") == F.col("_a"), "left")
    gone = revoked.select(F.col("signer").alias("_x")).distinct()
    out = out.join(gone, F.col("signature_signer") == F.col("_x"), "left")
    return out.withColumns({"role_listed": F.col("_r").isNotNull(), "role_granted": F.col("_g").isNotNull(), "other_roles_ok": F.coalesce("_roles_ok", F.lit(True)), "key_revoked": F.col("_x").isNotNull()}).drop("_role", "_r", "_g", "_s", "_a", "_roles_ok", "_x", "roles")
