"""The container format of artifacts: framing, validated decoding to plain values, and encoding.

A decoded artifact is a dict in the shape of ROW; a stage that fails raises Invalid with the stage's number, so
what is wrong first is told, as readers of the format agree.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import zstandard

from provspark.codec import cbor
from provspark.functions.scalars import CROSS_DOCUMENT, FLAGS, FLAGS2
from provspark.operators.graph import in_row_stuck

#: Fixed values of the format.
MAGIC, VERSION, VERSIONS = b"\x89SPIF\r\n\x1a\n", 3, (1, 2, 3)
CHUNKS = {"HEADER": 0, "PROVENANCE": 1, "SEMANTIC": 2, "TRACE": 3, "PAYLOAD": 4, "ALTS": 5, "DELTA": 6, "SIGNATURE": 7, "MULTISIG": 8, "TASK": 9, "ROLES": 10, "REVOCATION": 11, "TIMESTAMP": 12, "PARTIAL_TEXT": 16, "STREAM_META": 17, "STREAM_RESUME": 18, "CHECKSUM": 255}
NAMES = {v: k for k, v in CHUNKS.items()}
DISTRIBUTION, NODE_REF, EMBEDDING = 1000, 1001, 1002
SEMANTICS = ("factual_accuracy", "output_stability", "epistemic", "token_probability")
PROVENANCE = {"source_model": "", "model_version": "", "temperature": 0.0, "input_hash": "", "context_ref": "", "timestamp_ms": 0, "attempt": 0, "task_id": "", "risk_tier": "", "model_card": "", "training_data_hash": "", "energy_wh": 0.0, "human_oversight": "", "nonce": ""}
TASK = {"task_id": "", "attempt": 0, "status": "ok", "total_ms": 0, "tool_count": 0, "error_count": 0}
MOST_NODES, MOST_STATEMENTS, MOST_BYTES = 20_000, 4096, 10 << 20
#: Chunks that a signature covers, so that must come before it.
CONTENT = {CHUNKS[n] for n in ("HEADER", "PROVENANCE", "SEMANTIC", "TRACE", "PAYLOAD", "ALTS", "DELTA", "TASK", "ROLES")}
PACKED = ("PAYLOAD", "SEMANTIC", "TRACE", "ALTS", "DELTA")


class Invalid(ValueError):
    """kind: magic, version, format or checksum; stage: which of the ordered checks."""

    def __init__(self, kind: str, stage: int, why: str) -> None:
        super().__init__(why)
        self.kind, self.stage = kind, stage


def chunks(data: bytes, lenient: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(type, offset, payload) after the fixed header. lenient: stops where the bytes end early instead of failing."""
    at = len(MAGIC) + 2
    while at < len(data):
        if at + 5 > len(data):
            if lenient:
                return
            raise Invalid("format", 6, "truncated chunk header")
        kind, size = struct.unpack_from(">BI", data, at)
        if at + 5 + size > len(data) and not lenient:
            raise Invalid("format", 6, "truncated chunk payload")
        yield kind, at, data[at + 5 : at + 5 + size]
        at += 5 + size


def chunk(kind: int, payload: bytes) -> bytes:
    return struct.pack(">BI", kind, len(payload)) + payload


def listing(data: bytes) -> list[dict]:
    """Name, offset and length of each chunk, of broken files too."""
    return [{"name": NAMES.get(k, f"0x{k:02x}"), "type": k, "offset": at, "length": len(p)} for k, at, p in chunks(data, lenient=True)]


def signing_body(data: bytes) -> bytes:
    """What signatures cover: all before the first signature chunk, or before the checksum."""
    for kind, at, _ in chunks(data, lenient=True):
        if kind in (CHUNKS["SIGNATURE"], CHUNKS["MULTISIG"]):
            return data[:at]
    for kind, at, _ in chunks(data, lenient=True):
        if kind == CHUNKS["CHECKSUM"]:
            return data[:at]
    return data


def digest(data: bytes) -> str:
    return hashlib.sha256(signing_body(data)).hexdigest()


def sealed(body: bytes) -> bytes:
    return body + chunk(CHUNKS["CHECKSUM"], hashlib.sha256(body).digest())


def attached(data: bytes, name: str, value: Any) -> bytes:
    """An artifact with a chunk inserted before the checksum, or all of its type replaced by it where the first one was."""
    kind, own, out, done = CHUNKS[name], chunk(CHUNKS[name], cbor.encode(value)), [data[: len(MAGIC) + 2]], False
    for k, _, payload in chunks(data):
        if k in (kind, CHUNKS["CHECKSUM"]) and not done:
            out.append(own)
            done = True
        if k == CHUNKS["CHECKSUM"]:
            return sealed(b"".join(out))
        if k != kind:
            out.append(chunk(k, payload))
    raise ValueError("no checksum")


def unpacked(payload: bytes, how: str, name: str, stage: int) -> bytes:
    try:
        if how == "zstd":
            return zstandard.ZstdDecompressor().decompress(payload, max_output_size=MOST_BYTES)
        if how == "zlib":
            d = zlib.decompressobj()
            out = d.decompress(payload, MOST_BYTES)
            if d.unconsumed_tail or d.unused_data:
                raise Invalid("format", stage, f"{name} decompresses to too much")
            return out
    except (zlib.error, zstandard.ZstdError) as e:
        raise Invalid("format", stage, f"{name} can't be decompressed") from e
    return payload


class Checked:
    """Typed access to a decoded map: a missing field is its default, a wrong type an error."""

    def __init__(self, value: Any, name: str, stage: int) -> None:
        self.name, self.stage = name, stage
        self.map = self.of(value, dict)

    def of(self, value: Any, kind: type | tuple, what: str = "item") -> Any:
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            raise Invalid("format", self.stage, f"{self.name} {what} is of a wrong type")
        return value

    def get(self, key: str, default: Any, kind: type | tuple) -> Any:
        return self.of(self.map.get(key, default), kind, key)

    def need(self, key: str, kind: type | tuple = object) -> Any:
        if key not in self.map:
            raise Invalid("format", self.stage, f"{self.name} lacks {key}")
        value = self.map[key]
        return value if kind is object else self.of(value, kind, key)

    def fields(self, defaults: dict) -> dict:
        """Fields by the types of their defaults; numbers are finite and not negative."""
        out = {}
        for k, default in defaults.items():
            kind = (int, float) if isinstance(default, float) else type(default)
            out[k] = self.get(k, default, kind)
            if not isinstance(default, str) and not (math.isfinite(out[k]) and out[k] >= 0):
                raise Invalid("format", self.stage, f"{self.name} {k} is out of range")
        return out


def confidence(value: Any, name: str, stage: int) -> dict:
    if isinstance(value, cbor.Tag) and value.number == DISTRIBUTION:
        value = value.value
    at, number = Checked(value, name, stage), (int, float)
    out = {"mean": at.need("mean", number), "var": at.get("var", 0.0, number), "shape": at.get("shape", "gaussian", str), "semantics": at.get("semantics", "epistemic", str)}
    for k in ("p5", "p95"):
        out[k] = None if at.map.get(k) is None else at.need(k, number)
    given = [out[k] for k in ("mean", "p5", "p95") if out[k] is not None]
    ok = all(math.isfinite(x) and 0 <= x <= 1 for x in given) and math.isfinite(out["var"]) and out["var"] >= 0 and out["semantics"]
    if not ok or None not in (out["p5"], out["p95"]) and out["p5"] > out["p95"]:
        raise Invalid("format", stage, f"{name} has a confidence out of range")
    return {k: float(v) if isinstance(v, (int, float)) else v for k, v in out.items()}


def reference(value: Any, at: Checked) -> str:
    if isinstance(value, cbor.Tag) and value.number == NODE_REF:
        value = value.value
    return at.of(value, str, "ref")


def node(value: Any, name: str = "PAYLOAD", stage: int = 10) -> dict:
    at = Checked(value, name, stage)
    own = {"confidence": confidence(at.need("confidence"), name, stage), "refs": [reference(r, at) for r in at.get("refs", [], list)], "id": at.need("id", str), "type": at.need("type", str), "value": at.need("value")}
    if not own["id"]:
        raise Invalid("format", stage, f"{name} has an empty id")
    return own


def step(value: Any) -> dict:
    at = Checked(value, "TRACE", 11)
    own = {"confidence": confidence(at.need("confidence"), "TRACE", 11), "deps": [at.of(d, str, "dep") for d in at.get("deps", [], list)], "alternatives": at.get("alternatives", [], list), "id": at.need("id", str), "type": at.need("type", str), "value": at.need("content")}
    if not own["id"]:
        raise Invalid("format", 11, "TRACE has an empty id")
    return own


def acyclic(ids: list[str], deps: list[list[str]], name: str, stage: int) -> None:
    known = set(ids)
    if len(known) < len(ids):
        raise Invalid("format", stage, f"{name} has a duplicate id")
    if any(d not in known for row in deps for d in row):
        raise Invalid("format", stage, f"{name} has a dangling reference")
    if in_row_stuck(ids, deps):
        raise Invalid("format", stage, f"{name} has a cycle")


def signature(value: Any, name: str) -> dict:
    at = Checked(value, name, 12)
    return {"slot": "single" if name == "SIGNATURE" else "multi", "algorithm": at.need("algorithm", str), "signer": at.need("signer", str), "signature": at.need("signature", bytes), "key_id": at.get("key_id", "", str)}


def statement(value: Any) -> dict:
    at = Checked(value, "REVOCATION", 12)
    out = {"artifact_digest": at.need("artifact_digest", str), "signer": at.need("signer", str), "issued_ms": at.need("issued_ms", int), "reason": at.need("reason", str), "signature": at.get("signature", b"", bytes)}
    if out["issued_ms"] < 0:
        raise Invalid("format", 12, "REVOCATION issued_ms is negative")
    return out


def alternatives(raw: Any) -> tuple[bool, list[dict]]:
    bare = isinstance(raw, list)
    at = Checked({"alts": raw} if bare else raw, "ALTS", 11)
    normalized, out = at.get("normalized", True, bool), []
    for a in at.get("alts", [], list):
        one = Checked(a, "ALTS", 11)
        out.append({"weight": float(one.need("weight", (int, float))), "nodes": [node(n, "ALTS", 11) for n in one.need("nodes", list)]})
    weights = [a["weight"] for a in out]
    if not all(map(math.isfinite, weights)) or normalized and weights and (not bare and abs(sum(weights) - 1) > 0.01 or not all(0 <= w <= 1 for w in weights)):
        raise Invalid("format", 11, "ALTS weights are out of range")
    return normalized, out


def semantic(raw: Any) -> dict:
    at, number = Checked(raw, "SEMANTIC", 11), (int, float)
    vector = at.map.get("embedding", [])
    vector = vector.value if isinstance(vector, cbor.Tag) and vector.number == EMBEDDING else vector
    vector = [float(at.of(x, number, "embedding")) for x in at.of(vector, list, "embedding")]
    cov = [[float(at.of(x, number, "covariance")) for x in at.of(r, list, "covariance")] for r in at.get("covariance", [], list)]
    square = not cov or len(cov) == len(vector) and all(len(r) == len(vector) for r in cov)
    if not square or not all(map(math.isfinite, vector)) or not all(math.isfinite(x) for r in cov for x in r):
        raise Invalid("format", 11, "SEMANTIC numbers are out of range")
    return {"embedding_model": at.get("embedding_model", "", str), "dim": len(vector), "embedding": vector, "covariance": cov}


def framed(data: bytes) -> tuple[int, dict[int, list[bytes]]]:
    """Version and payloads by chunk type, after the checks of bytes and framing."""
    if len(data) < len(MAGIC) + 2 or not data.startswith(MAGIC):
        raise Invalid("magic", 1, "bad magic")
    version = data[len(MAGIC)]
    if version not in VERSIONS:
        raise Invalid("version", 2, f"unsupported version {version}")
    seal = next(((at, p) for k, at, p in chunks(data, lenient=True) if k == CHUNKS["CHECKSUM"]), None)
    if seal is None:
        raise Invalid("format", 3, "no CHECKSUM chunk")
    at, stored = seal
    if hashlib.sha256(data[:at]).digest() != stored:
        raise Invalid("checksum", 4, "Checksum mismatch")
    if at + 5 + struct.unpack_from(">I", data, at + 1)[0] != len(data):
        raise Invalid("format", 5, "the checksum isn't what the bytes end with")
    found: dict[int, list[bytes]] = {}
    signed = False
    for kind, _, payload in chunks(data[:at]):
        if kind in found and kind < 16:
            raise Invalid("format", 6, f"duplicate chunk 0x{kind:02x}")
        if signed and kind in CONTENT:
            raise Invalid("format", 6, f"chunk 0x{kind:02x} after the signature")
        signed = signed or kind in (CHUNKS["SIGNATURE"], CHUNKS["MULTISIG"])
        found.setdefault(kind, []).append(payload)
    if CHUNKS["SIGNATURE"] in found and CHUNKS["MULTISIG"] in found:
        raise Invalid("format", 7, "two kinds of attestation")
    return version, found


def decode(data: bytes) -> dict:
    """All layers of an artifact, validated in order."""
    version, found = framed(data)
    signed = CHUNKS["SIGNATURE"] in found or CHUNKS["MULTISIG"] in found
    packing = ""

    def load(name: str, stage: int) -> Any:
        raw = unpacked(found[CHUNKS[name]][0], packing if name in PACKED else "", name, stage)
        try:
            value, form = cbor.decode(raw)
        except cbor.Malformed as e:
            raise Invalid("format", stage, f"{name}: {e}") from e
        breach = signed and (form.strict or version == 3 and form.deterministic)
        if breach:
            raise Invalid("format", stage, f"{name} isn't canonical: {breach}")
        return value

    has = lambda name: CHUNKS[name] in found
    out: dict[str, Any] = {"wire_version": version, "flags": data[len(MAGIC) + 1], "flags2": 0, "created_ms": 0}
    if has("HEADER"):
        header = Checked(load("HEADER", 9), "HEADER", 9)
        out["flags2"] = header.get("flags2", 0, int)
        packing = "zstd" if out["flags2"] & FLAGS2["zstd"] else "zlib" if out["flags2"] & FLAGS2["compressed"] else ""
        made = header.map.get("created_ms", 0)
        out["created_ms"] = made if isinstance(made, int) and 0 <= made < 1 << 63 else 0
    if not has("PAYLOAD"):
        raise Invalid("format", 10, "no PAYLOAD chunk")
    raw = load("PAYLOAD", 10)
    if not isinstance(raw, list) or not 0 < len(raw) <= MOST_NODES:
        raise Invalid("format", 10, "PAYLOAD isn't a list of 1 to 20000 nodes")
    out["payload"] = [node(n) for n in raw]
    ids = {n["id"] for n in out["payload"]}
    foreign = CROSS_DOCUMENT.split(":")[0] + ":"
    acyclic([n["id"] for n in out["payload"]], [[r for r in n["refs"] if r in ids or not r.startswith(foreign)] for n in out["payload"]], "PAYLOAD", 10)
    out["provenance"] = Checked(load("PROVENANCE", 11), "PROVENANCE", 11).fields(PROVENANCE) if has("PROVENANCE") else None
    out["semantic"] = semantic(load("SEMANTIC", 11)) if has("SEMANTIC") else None
    out["trace_method"], out["trace"] = "post-hoc", []
    if has("TRACE"):
        raw = load("TRACE", 11)
        if not isinstance(raw, list):
            at = Checked(raw, "TRACE", 11)
            out["trace_method"], raw = at.get("method", "post-hoc", str), at.get("steps", [], list)
        out["trace"] = [step(s) for s in raw]
        acyclic([s["id"] for s in out["trace"]], [s["deps"] for s in out["trace"]], "TRACE", 11)
    out["normalized"], out["alternatives"] = alternatives(load("ALTS", 11)) if has("ALTS") else (True, [])
    out["delta"] = None
    if has("DELTA"):
        at = Checked(load("DELTA", 11), "DELTA", 11)
        out["delta"] = {"base_hash": at.need("base_hash", str), "changes": [at.of(c, dict, "change") for c in at.get("changes", [], list)]}
    out["signatures"] = [signature(load("SIGNATURE", 12), "SIGNATURE")] if has("SIGNATURE") else []
    if has("MULTISIG"):
        raw = load("MULTISIG", 12)
        if not isinstance(raw, list):
            raise Invalid("format", 12, "MULTISIG isn't a list")
        out["signatures"] = [signature(s, "MULTISIG") for s in raw]
        if len({s["signer"] for s in out["signatures"]}) < len(raw):
            raise Invalid("format", 12, "a signer signs twice")
    out["task"] = Checked(load("TASK", 12), "TASK", 12).fields(TASK) if has("TASK") else None
    roles = Checked(load("ROLES", 12) if has("ROLES") else {}, "ROLES", 12)
    out["signer_roles"] = {roles.of(k, str, "key"): roles.of(v, str, "value") for k, v in roles.map.items()}
    raw = load("REVOCATION", 12) if has("REVOCATION") else []
    if not isinstance(raw, list) or len(raw) > MOST_STATEMENTS:
        raise Invalid("format", 12, "REVOCATION isn't a list of at most 4096 statements")
    out["revocations"] = [statement(s) for s in raw]
    out["timestamp_anchor"] = None
    if has("TIMESTAMP"):
        at = Checked(load("TIMESTAMP", 12), "TIMESTAMP", 12)
        out["timestamp_anchor"] = {"authority": at.need("authority", str), "time_ms": at.need("time_ms", int), "token": at.get("token", b"", bytes)}
        if out["timestamp_anchor"]["time_ms"] < 0:
            raise Invalid("format", 12, "TIMESTAMP time_ms is negative")
    return out


# --- encoding


def tagged(c: dict) -> cbor.Tag:
    return cbor.Tag(DISTRIBUTION, {k: v for k, v in c.items() if v is not None})


def node_out(n: dict) -> dict:
    return {"id": n["id"], "type": n["type"], "value": n["value"], "confidence": tagged(n["confidence"]), "refs": [cbor.Tag(NODE_REF, r) for r in n.get("refs", [])]}


def step_out(s: dict) -> dict:
    return {"id": s["id"], "type": s["type"], "content": s["value"], "confidence": tagged(s["confidence"]), "deps": s.get("deps", []), "alternatives": s.get("alternatives", [])}


def provenance_out(p: dict | None) -> dict | None:
    return None if p is None else PROVENANCE | p


def content_id(doc: dict) -> str:
    """SHA-256 of payload, trace and provenance alone."""
    return hashlib.sha256(cbor.encode({"payload": [*map(node_out, doc["payload"])], "trace": [*map(step_out, doc.get("trace", []))], "provenance": provenance_out(doc.get("provenance"))})).hexdigest()


def encode(doc: dict, packing: str = "") -> bytes:
    """An artifact of the current version from the shape that decode() returns. packing: '', 'zlib' or 'zstd'."""
    signatures = doc.get("signatures") or []
    multi = bool(signatures) and signatures[0].get("slot") == "multi"
    present = {"provenance": doc.get("provenance"), "semantic": doc.get("semantic"), "trace": doc.get("trace"), "alternatives": doc.get("alternatives"), "delta": doc.get("delta"), "signature": signatures and not multi, "multisig": multi}
    flags = sum(FLAGS[k] for k, v in present.items() if v)
    flags2 = {"": 0, "zlib": FLAGS2["compressed"], "zstd": FLAGS2["zstd"]}[packing] + (FLAGS2["task"] if doc.get("task") else 0)
    prov = provenance_out(doc.get("provenance"))
    out = [MAGIC, bytes([VERSION, flags])]

    def put(name: str, value: Any) -> None:
        raw = cbor.encode(value)
        if packing and name in PACKED:
            raw = zstandard.ZstdCompressor().compress(raw) if packing == "zstd" else zlib.compress(raw)
        out.append(chunk(CHUNKS[name], raw))

    put("HEADER", {"version": VERSION, "flags": flags, "flags2": flags2, "created_ms": prov["timestamp_ms"] if prov else 0})
    if doc.get("task"):
        put("TASK", TASK | doc["task"])
    if prov:
        put("PROVENANCE", prov)
    if doc.get("semantic"):
        s = doc["semantic"]
        put("SEMANTIC", {"embedding_model": s["embedding_model"], "dim": len(s["embedding"]), "embedding": cbor.Tag(EMBEDDING, s["embedding"]), "covariance": s.get("covariance", [])})
    if doc.get("trace"):
        put("TRACE", {"method": doc.get("trace_method", "post-hoc"), "steps": [*map(step_out, doc["trace"])]})
    put("PAYLOAD", [*map(node_out, doc["payload"])])
    if doc.get("alternatives"):
        put("ALTS", {"normalized": doc.get("normalized", True), "alts": [{"weight": a["weight"], "nodes": [*map(node_out, a["nodes"])]} for a in doc["alternatives"]]})
    if doc.get("delta"):
        put("DELTA", doc["delta"])
    if doc.get("signer_roles"):
        put("ROLES", doc["signer_roles"])
    plain = [{k: s[k] for k in ("algorithm", "signer", "signature", "key_id")} for s in signatures]
    if plain:
        put("MULTISIG" if multi else "SIGNATURE", plain if multi else plain[0])
    if doc.get("revocations"):
        put("REVOCATION", doc["revocations"])
    if doc.get("timestamp_anchor"):
        put("TIMESTAMP", doc["timestamp_anchor"])
    return sealed(b"".join(out))


def signed(doc: dict, signers: list[tuple[str, Any]], packing: str = "", multi: bool | None = None) -> bytes:
    """An artifact with Ed25519 signatures; signers are (id, function from body to signature)."""
    multi = len(signers) > 1 if multi is None else multi
    blank = [{"slot": "multi" if multi else "single", "algorithm": "ed25519", "signer": s, "signature": b"\0" * 64, "key_id": ""} for s, _ in signers]
    body = signing_body(encode(doc | {"signatures": blank}, packing))
    return encode(doc | {"signatures": [b | {"signature": f(body)} for b, (_, f) in zip(blank, signers)]}, packing)


def statement_bytes(s: dict) -> bytes:
    return cbor.encode({k: s[k] for k in ("artifact_digest", "signer", "issued_ms", "reason")})


def anchor_bytes(artifact_digest: str, time_ms: int) -> bytes:
    return cbor.encode({"artifact_digest": artifact_digest, "time_ms": time_ms})


def text_of(value: Any) -> str:
    """Any value as JSON text, for columns; bytes as hexadecimal, tags as objects. Lossy only in types."""

    def plain(x: Any) -> Any:
        if isinstance(x, bytes):
            return {"$bytes": x.hex()}
        if isinstance(x, cbor.Tag):
            return {"$tag": x.number, "value": plain(x.value)}
        if isinstance(x, cbor.Simple):
            return {"$simple": x.number}
        if isinstance(x, float) and not math.isfinite(x):
            return {"$float": str(x)}
        if isinstance(x, dict):
            return {k if isinstance(k, str) else json.dumps(plain(k)): plain(v) for k, v in x.items()}
        return [*map(plain, x)] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


def kind_of(value: Any) -> str:
    for kind, types in (("null", type(None)), ("bool", bool), ("int", int), ("float", float), ("text", str), ("bytes", bytes), ("list", list), ("map", dict)):
        if isinstance(value, types):
            return kind
    return {DISTRIBUTION: "dist", NODE_REF: "ref", EMBEDDING: "embedding"}.get(getattr(value, "number", None), "other")
