"""Keys that follow one another, and envelopes for transport."""

from __future__ import annotations

import base64
import binascii
import hashlib
from typing import Any

from provspark.codec import cbor, ed25519


def rotation_bytes(old: str, new: str, ts: int) -> bytes:
    return cbor.encode({"old_signer": old, "superseded_by": new, "ts": ts})


def rotated(old_seed: bytes, new_seed: bytes, old: str, new: str, ts: int) -> dict:
    """A record in which both keys sign that the new one follows the old one."""
    body = rotation_bytes(old, new, ts)
    sign = lambda seed: base64.b64encode(ed25519.sign(seed, body)).decode()
    return {"old_signer": old, "superseded_by": new, "timestamp_ms": ts, "proof": sign(old_seed), "new_key_proof": sign(new_seed)}


def rotation_ok(record: dict, old_key: bytes, new_key: bytes) -> bool:
    """Whether both proofs of a record are good; False for anything malformed."""
    try:
        body = rotation_bytes(record["old_signer"], record["superseded_by"], record["timestamp_ms"])
        proofs = [base64.b64decode(record[k], validate=True) for k in ("proof", "new_key_proof")]
    except (KeyError, TypeError, ValueError, binascii.Error):
        return False
    return all(ed25519.verify(k, body, p) for k, p in zip((old_key, new_key), proofs))


def successors(records: list[dict], keys: dict[str, bytes]) -> dict[str, str]:
    """By signer, the last one that follows it through good records; a ring of records ends where it began."""
    next_of = {r["old_signer"]: r["superseded_by"] for r in records if r.get("old_signer") in keys and r.get("superseded_by") in keys and rotation_ok(r, keys[r["old_signer"]], keys[r["superseded_by"]])}
    out = {}
    for start in next_of:
        seen, at = {start}, next_of[start]
        while at in next_of and at not in seen:
            seen.add(at)
            at = next_of[at]
        out[start] = at
    return out


#: Field names of an envelope.
TEXTS, ARTIFACT, MANIFEST = ("content", "visible_label", "machine_readable_mark"), "spif_b64", "c2pa_manifest_b64"


def envelope(content: str, visible_label: str, machine_readable_mark: str, artifact: bytes, manifest: bytes | None = None) -> dict:
    """A JSON-safe envelope; every text must be there, and bytes not be empty."""
    out: dict[str, Any] = dict(zip(TEXTS, (content, visible_label, machine_readable_mark)))
    if not all(isinstance(v, str) and v.strip() for v in out.values()) or not isinstance(artifact, bytes) or not artifact or manifest is not None and not manifest:
        raise ValueError("an envelope has texts and bytes that aren't empty")
    out[ARTIFACT] = base64.b64encode(artifact).decode()
    if manifest is not None:
        out[MANIFEST] = base64.b64encode(manifest).decode()
    return out


def opened(value: dict) -> tuple[str, str, str, bytes, bytes | None]:
    """What envelope() was made of."""
    try:
        texts = [value[k] for k in TEXTS]
        artifact = base64.b64decode(value[ARTIFACT], validate=True)
        manifest = value.get(MANIFEST)
        manifest = None if manifest is None else base64.b64decode(manifest, validate=True)
    except (KeyError, TypeError, binascii.Error) as e:
        raise ValueError("not an envelope") from e
    envelope(*texts, artifact, manifest)
    return *texts, artifact, manifest


def vector_fingerprint(vector: list[float]) -> str:
    """16 hexadecimal digits of the first 32 numbers in thousandths, modulo 256."""
    return hashlib.sha256(bytes(int(x * 1000) & 0xFF for x in vector[:32])).hexdigest()[:16]
