"""Streams of artifacts that are still being made: an incremental reader, and a writer for tests.

A stream is an artifact whose text comes in numbered parts before its payload. The reader takes bytes as
they come, in any cuts, and gives events: opened, partial_text, resumed, verified, error. An error ends a stream.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from provspark.codec import artifact as A
from provspark.codec import cbor

#: Bytes that a stream may hold before it is given up.
MOST = 64 << 20


class Broken(ValueError):
    """What ends a stream."""


class Reader:
    """Feed bytes, get events as dicts (event, node_id, seq, text, error). The state is plain data, so it can be pickled."""

    def __init__(self, resume: tuple[int, bytes] | None = None, any_resume: bool = False, require_signature: bool = False) -> None:
        self.held, self.at = b"", 0
        self.opened = self.over = self.resumed = False
        self.floor, self.last, self.texts = 0, {}, {}
        self.resume, self.any_resume, self.require_signature = resume, any_resume, require_signature

    def feed(self, data: bytes) -> list[dict]:
        events: list[dict] = []
        if self.over:
            return events
        self.held += data
        try:
            if len(self.held) > MOST:
                raise Broken("the stream is too long")
            self.read(events)
        except (Broken, cbor.Malformed, A.Invalid) as e:
            self.over = True
            events.append({"event": "error", "error": str(e)})
        return events

    def read(self, events: list[dict]) -> None:
        start = len(A.MAGIC) + 2
        if not self.opened:
            have = self.held[: len(A.MAGIC)]
            if not A.MAGIC.startswith(have):
                raise Broken("bad magic")
            if len(self.held) < start:
                return
            if self.held[len(A.MAGIC)] not in A.VERSIONS:
                raise Broken("unsupported version")
            self.opened, self.at = True, start
            events.append({"event": "opened"})
        while len(self.held) >= self.at + 5 and not self.over:
            kind, size = struct.unpack_from(">BI", self.held, self.at)
            end = self.at + 5 + size
            if len(self.held) < end:
                return
            payload = self.held[self.at + 5 : end]
            self.at = end
            if kind == A.CHUNKS["PARTIAL_TEXT"]:
                events.append(self.part(payload))
            elif kind == A.CHUNKS["STREAM_RESUME"]:
                events.append(self.continued(payload))
            elif kind == A.CHUNKS["CHECKSUM"]:
                events.append(self.committed(self.held[:end]))

    def fields(self, payload: bytes, name: str, kinds: dict[str, tuple]) -> list:
        value, _ = cbor.decode(payload)
        if not isinstance(value, dict):
            raise Broken(f"{name} isn't a map")
        out = []
        for key, (kind, default) in kinds.items():
            x = value.get(key, default)
            if not isinstance(x, kind) or isinstance(x, bool):
                raise Broken(f"{name} {key} is of a wrong type")
            out.append(x)
        return out

    def part(self, payload: bytes) -> dict:
        node, seq, text = self.fields(payload, "PARTIAL_TEXT", {"node_id": (str, "main"), "seq": (int, 0), "text": (str, "")})
        if seq < self.floor:
            raise Broken(f"seq {seq} of {node} is below the resume point {self.floor}")
        if seq <= self.last.get(node, -1):
            raise Broken(f"seq {seq} of {node} isn't above {self.last[node]}")
        self.last[node] = seq
        self.texts.setdefault(node, []).append(text)
        return {"event": "partial_text", "node_id": node, "seq": seq, "text": text}

    def continued(self, payload: bytes) -> dict:
        seq, digest = self.fields(payload, "STREAM_RESUME", {"seq": (int, 0), "body_hash": (bytes, b"")})
        if len(digest) != 32:
            raise Broken("STREAM_RESUME body_hash isn't 32 bytes")
        if self.resumed:
            raise Broken("the stream resumes twice")
        if self.texts:
            raise Broken("the stream resumes after text")
        if self.resume is not None and self.resume != (seq, digest):
            raise Broken("the resume point isn't the expected one")
        if self.resume is None and not self.any_resume:
            raise Broken("no resume point is expected")
        self.resumed, self.floor = True, seq
        return {"event": "resumed", "seq": seq, "text": token(seq, digest)}

    def committed(self, whole: bytes) -> dict:
        doc = A.decode(whole)
        if self.require_signature and not doc["signatures"]:
            raise Broken("a signature is required")
        values = {n["id"]: n["value"] for n in doc["payload"]}
        for node, parts in self.texts.items():
            value, text = values.get(node), "".join(parts)
            if not isinstance(value, str) or not (value.endswith(text) if self.resumed else value == text):
                raise Broken(f"streamed text of {node} isn't that of the payload")
        self.over = True
        return {"event": "verified", "text": A.content_id(doc)}


def token(seq: int, digest: bytes) -> str:
    return base64.urlsafe_b64encode(struct.pack(">I", seq) + digest).decode()


def parsed_token(text: str) -> tuple[int, bytes]:
    raw = base64.urlsafe_b64decode(text)
    if len(raw) != 36:
        raise ValueError("a resume token has 36 bytes")
    return struct.unpack(">I", raw[:4])[0], raw[4:]


def written(doc: dict, parts: list[tuple[str, int, str]], resume: tuple[int, bytes] | None = None) -> bytes:
    """A stream that ends as doc: parts (node, seq, text) come right after the header chunk."""
    data = A.encode(doc)
    first = next(A.chunks(data))
    cut = first[1] + 5 + len(first[2])
    extra = [A.chunk(A.CHUNKS["STREAM_RESUME"], cbor.encode({"seq": resume[0], "body_hash": resume[1]}))] if resume else []
    extra += [A.chunk(A.CHUNKS["PARTIAL_TEXT"], cbor.encode({"node_id": n, "seq": s, "text": t})) for n, s, t in parts]
    rest = A.signing_body(data)[cut:]
    return A.sealed(data[:cut] + b"".join(extra) + rest)


def events_of(data: bytes) -> list[dict]:
    """All events of a stored stream."""
    reader = Reader(any_resume=True)
    out = reader.feed(data)
    return out if reader.over else [*out, {"event": "error", "error": "the stream ends before its checksum"}]


def prefix_digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()
