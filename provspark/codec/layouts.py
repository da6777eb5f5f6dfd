"""The format's two layouts for exchange, which other readers take: compact JSON for text-only channels, and MessagePack.

Compact JSON has all fields of payload, trace and provenance under short names, values as text; of an embedding it keeps a fingerprint.
MessagePack keeps values, bytes and signatures. Both carry a checksum of their body.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from provspark.codec import artifact as A
from provspark.codec import cbor
from provspark.codec.exchange import CERTAIN, Mismatch, pack, unpack
from provspark.codec.keys import vector_fingerprint

#: What the layouts call themselves, short names by field, and how MessagePack marks typed values.
JSON_HEAD, PACK_HEAD = {"fmt": "spif", "v": "0.2"}, {"fmt": "spif", "enc": "msgpack", "v": "0.2"}
SHORT_PROVENANCE = {"source_model": "m", "model_version": "mv", "temperature": "tmp", "timestamp_ms": "ts", "input_hash": "ih", "context_ref": "cr"}
SHORT_DIST = {"mean": "m", "var": "v", "shape": "s", "semantics": "sem", "p5": "p5", "p95": "p95"}
SHORT_NODE = {"id": "id", "type": "t", "value": "val", "confidence": "c", "refs": "refs"}
SHORT_STEP = {"id": "id", "type": "t", "value": "cont", "confidence": "c", "deps": "deps", "alternatives": "alts"}
TYPE = "__spif_type__"
#: What is left out where it is empty or null.
OPTIONAL = frozenset(("context_ref", "semantics", "p5", "p95", "refs", "deps", "alternatives"))


def named(x: dict, names: dict[str, str], how: dict[str, Any]) -> dict:
    return {short: how.get(n, lambda v: v)(x[n]) for n, short in names.items() if n in x and (n not in OPTIONAL or x[n] not in ("", None, []))}


def unnamed(x: dict, names: dict[str, str], how: dict[str, Any], defaults: dict) -> dict:
    return defaults | {n: how.get(n, lambda v: v)(x[short]) for n, short in names.items() if short in x}


def canonical(body: dict) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def to_compact(doc: dict) -> str:
    text = lambda v: v if isinstance(v, str) else str(v)
    dist = lambda c: named(c, SHORT_DIST, {})
    node = lambda n, names=SHORT_NODE: named(n, names, {"value": text, "confidence": dist, "alternatives": lambda xs: [*map(text, xs)]})
    body: dict[str, Any] = dict(JSON_HEAD)
    if doc.get("provenance"):
        body["prov"] = named(doc["provenance"], SHORT_PROVENANCE, {})
    body["payload"] = [*map(node, doc["payload"])]
    if doc.get("trace"):
        body |= {"trace": [node(s, SHORT_STEP) for s in doc["trace"]], "tm": doc.get("trace_method", "post-hoc")}
    if doc.get("alternatives"):
        body["alts"] = [{"w": a["weight"], "norm": doc.get("normalized", True), "nodes": [node(n | {"refs": []}) for n in a["nodes"]]} for a in doc["alternatives"]]
    if s := doc.get("semantic"):
        body["sem"] = {"model": s["embedding_model"], "dim": len(s["embedding"]), "fp": vector_fingerprint(s["embedding"])}
    if doc.get("delta"):
        body["delta"] = {"base": doc["delta"]["base_hash"]}
    return json.dumps(body | {"cksum": canonical(body)}, separators=(",", ":"), ensure_ascii=False)


def from_compact(text: str) -> dict:
    body = json.loads(text)
    if not isinstance(body, dict) or body.pop("cksum", None) != canonical(body):
        raise Mismatch("the checksum isn't that of the body")
    dist = lambda c: unnamed(c, SHORT_DIST, {}, CERTAIN | {"semantics": ""})
    node = lambda n: unnamed(n, SHORT_NODE, {"confidence": dist}, {"refs": []})
    prov = body.get("prov")
    return {
        "payload": [*map(node, body.get("payload", []))],
        "provenance": prov and unnamed(prov, SHORT_PROVENANCE, {}, A.PROVENANCE | {"model_version": prov["m"]}),
        "trace": [unnamed(s, SHORT_STEP, {"confidence": dist}, {"deps": [], "alternatives": []}) for s in body.get("trace", [])],
        "trace_method": body.get("tm", "post-hoc"),
        "alternatives": [{"weight": a["w"], "nodes": [*map(node, a.get("nodes", []))]} for a in body.get("alts", [])],
        "normalized": all(a.get("norm", True) for a in body.get("alts", [])),
        "delta": {"base_hash": body["delta"]["base"], "changes": []} if "delta" in body else None,
        "signatures": [],
    }


def tagged(x: Any) -> Any:
    """A value with distributions and references as marked maps."""
    if isinstance(x, cbor.Tag):
        if x.number == A.DISTRIBUTION:
            return {TYPE: "Distribution"} | tagged(x.value)
        return {TYPE: "NodeRef", "node_id": x.value} if x.number == A.NODE_REF else tagged(x.value)
    if isinstance(x, dict):
        return {k: tagged(v) for k, v in x.items()}
    return [tagged(v) for v in x] if isinstance(x, (list, tuple)) else x


def untagged(x: Any) -> Any:
    if isinstance(x, dict):
        kind, rest = x.get(TYPE), {k: untagged(v) for k, v in x.items() if k != TYPE}
        return cbor.Tag(A.DISTRIBUTION, rest) if kind == "Distribution" else cbor.Tag(A.NODE_REF, rest["node_id"]) if kind == "NodeRef" else rest
    return [untagged(v) for v in x] if isinstance(x, list) else x


def to_packed(doc: dict) -> bytes:
    dist = lambda c: {k: v for k, v in c.items() if v is not None}
    node = lambda n: {"id": n["id"], "type": n["type"], "value": tagged(n["value"]), "confidence": dist(n["confidence"]), "refs": n.get("refs", [])}
    step = lambda s: {"id": s["id"], "type": s["type"], "content": tagged(s["value"]), "confidence": dist(s["confidence"]), "deps": s.get("deps", []), "alternatives": tagged(s.get("alternatives", []))}
    signature = lambda s: {k: s[k] for k in ("algorithm", "signer", "signature", "key_id")}
    body: dict[str, Any] = dict(PACK_HEAD)
    if doc.get("provenance"):
        body["prov"] = {k: doc["provenance"][k] for k in SHORT_PROVENANCE}
    body |= {"payload": [*map(node, doc["payload"])], "trace": [*map(step, doc.get("trace") or [])], "trace_method": doc.get("trace_method", "post-hoc")}
    if doc.get("alternatives"):
        body["alts"] = [{"weight": a["weight"], "normalized": doc.get("normalized", True), "nodes": [*map(node, a["nodes"])]} for a in doc["alternatives"]]
    if s := doc.get("semantic"):
        body["semantic"] = {k: s.get(k, []) for k in ("embedding", "embedding_model", "covariance")}
    if doc.get("delta"):
        body["delta"] = {"base_hash": doc["delta"]["base_hash"], "changes": tagged(doc["delta"].get("changes", []))}
    one = [s for s in doc.get("signatures") or [] if s.get("slot") == "single"]
    many = [s for s in doc.get("signatures") or [] if s.get("slot") != "single"]
    body |= ({"signature": signature(one[0])} if one else {}) | ({"signatures": [*map(signature, many)]} if many else {})
    return pack({"body": body, "cksum": hashlib.sha256(pack(body)).digest()})


def from_packed(data: bytes) -> dict:
    outer = unpack(data)
    body = outer.get("body") if isinstance(outer, dict) else None
    if not isinstance(body, dict) or hashlib.sha256(pack(body)).digest() != outer.get("cksum"):
        raise Mismatch("the checksum isn't that of the body")
    dist = lambda c: CERTAIN | c
    node = lambda n: {"id": n["id"], "type": n["type"], "value": untagged(n["value"]), "confidence": dist(n["confidence"]), "refs": n.get("refs", [])}
    step = lambda s: {"id": s["id"], "type": s["type"], "value": untagged(s["content"]), "confidence": dist(s["confidence"]), "deps": s.get("deps", []), "alternatives": untagged(s.get("alternatives", []))}
    signed = [{"slot": "single"} | body["signature"]] if "signature" in body else [{"slot": "multi"} | s for s in body.get("signatures", [])]
    return {
        "payload": [*map(node, body.get("payload", []))], "provenance": A.PROVENANCE | body["prov"] if "prov" in body else None, "trace": [*map(step, body.get("trace", []))], "trace_method": body.get("trace_method", "post-hoc"),
        "alternatives": [{"weight": a["weight"], "nodes": [*map(node, a.get("nodes", []))]} for a in body.get("alts", [])], "normalized": all(a.get("normalized", True) for a in body.get("alts", [])),
        "semantic": body.get("semantic"), "delta": body.get("delta") and {"base_hash": body["delta"]["base_hash"], "changes": untagged(body["delta"].get("changes", []))}, "signatures": signed,
    }
