"""CBOR, Ed25519 and the container format: published vectors, round trips, forms and tampering."""

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.codec import artifact as A
from provspark.codec import cbor, ed25519
from provspark.functions.scalars import CROSS_DOCUMENT

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False) | st.text(max_size=9) | st.binary(max_size=9),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4) | st.integers(-9, 9), x, max_size=4) | st.builds(cbor.Tag, st.integers(1000, 1099), x),
    max_leaves=20,
)


@settings(max_examples=500, deadline=None)
@given(VALUES)
def test_cbor_round_trip(x):
    back, form = cbor.decode(cbor.encode(x))
    assert back == x and cbor.encode(back) == cbor.encode(x)
    assert form.strict is None and form.deterministic is None


@settings(max_examples=1000, deadline=None)
@given(st.binary(max_size=40))
def test_cbor_never_breaks(data):
    try:
        cbor.decode(data)
    except cbor.Malformed:
        pass


@pytest.mark.parametrize("text,value", [("00", 0), ("1818", 24), ("3903e7", -1000), ("c249010000000000000000", 2**64), ("f93c00", 1.0), ("fb3ff199999999999a", 1.1), ("f97c00", math.inf), ("6449455446", "IETF"), ("83010203", [1, 2, 3]), ("a201020304", {1: 2, 3: 4}), ("f6", None)])
def test_cbor_published_examples(text, value):
    assert cbor.decode(bytes.fromhex(text))[0] == value and cbor.encode(value).hex() == text


@pytest.mark.parametrize("text,strict,sorted_", [("1817", False, True), ("9f01ff", False, True), ("5f4101ff", False, True), ("a2616201616101", True, False), ("fb3ff0000000000000", True, False), ("fa7fc00000", True, False), ("c24101", True, False), ("c249000000000000000001", True, False), ("f818", None, None), ("a2616101616102", None, None), ("a261610178016102", None, None), ("ff", None, None), ("1c", None, None), ("0000", None, None), ("62c328", None, None)])
def test_cbor_forms(text, strict, sorted_):
    if strict is None and text != "f818":
        with pytest.raises(cbor.Malformed):
            cbor.decode(bytes.fromhex(text))
        return
    _, form = cbor.decode(bytes.fromhex(text))
    assert (form.strict is None, form.deterministic is None) == ((strict, sorted_) if strict is not None else (False, True))


def test_deep_nesting_is_an_error_not_a_crash():
    with pytest.raises(cbor.Malformed):
        cbor.decode(b"\x81" * 100_000)


@pytest.mark.parametrize("seed,key,message,signature", [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
])
def test_ed25519_published_examples(seed, key, message, signature):
    seed, key, message, signature = map(bytes.fromhex, (seed, key, message, signature))
    assert ed25519.public_key(seed) == key and ed25519.sign(seed, message) == signature
    assert ed25519.verify(key, message, signature)
    assert not ed25519.verify(key, message + b"!", signature)
    assert not ed25519.verify(key, message, signature[:32] + (int.from_bytes(signature[32:], "little") + ed25519.ORDER).to_bytes(32, "little"))


def test_weak_keys():
    assert ed25519.weak(bytes(32)) and ed25519.weak(b"\x01" + bytes(31)) and ed25519.weak(b"\xff" * 32)
    assert not ed25519.verify(b"\x01" + bytes(31), b"any", b"\x01" + bytes(63))


def distribution(r):
    return {"mean": r.random(), "var": r.random() / 2, "shape": r.choice(["gaussian", "beta", "point"]), "semantics": "epistemic", "p5": None, "p95": None}


def document(seed: int) -> dict:
    r = random.Random(seed)
    nodes = [{"id": f"n{i}", "type": r.choice(["text", "fact", "tool_call"]), "value": r.choice(["words", 7, {"a": [1, b"x"]}, None]), "confidence": distribution(r), "refs": [f"n{j}" for j in range(i) if r.random() < 0.3]} for i in range(r.randint(1, 6))]
    steps = [{"id": f"t{i}", "type": "inference", "value": "thought", "confidence": distribution(r), "deps": [f"t{i - 1}"] if i else [], "alternatives": []} for i in range(r.randint(0, 4))]
    doc = {"payload": nodes, "trace": steps, "provenance": {"source_model": "m", "timestamp_ms": r.randrange(10**12), "temperature": 0.5, "nonce": str(seed)}}
    if r.random() < 0.5:
        doc |= {"semantic": {"embedding_model": "e", "embedding": [r.random() for _ in range(4)], "covariance": []}, "task": {"task_id": "t", "total_ms": 5}, "signer_roles": {"a": "model_provider"}}
    if r.random() < 0.5:
        doc |= {"alternatives": [{"weight": w, "nodes": nodes[:1]} for w in (0.25, 0.75)], "delta": {"base_hash": "0" * 64, "changes": [{"op": "x"}]}}
    return doc


@pytest.mark.parametrize("packing", ["", "zlib", "zstd"])
def test_artifact_round_trip(packing):
    for seed in range(30):
        doc = document(seed)
        data = A.encode(doc, packing)
        back = A.decode(data)
        assert back["payload"] == [n | {"refs": n["refs"]} for n in doc["payload"]]
        assert [s["id"] for s in back["trace"]] == [s["id"] for s in doc["trace"]]
        assert A.content_id(back) == A.content_id(doc)
        assert A.encode(back | {"semantic": back["semantic"], "task": back["task"]}, packing) == data


def keys(n):
    out = []
    for i in range(n):
        seed = bytes([i + 1]) * 32
        import base64

        out.append((base64.b64encode(ed25519.public_key(seed)).decode(), lambda m, s=seed: ed25519.sign(s, m)))
    return out


def test_signed_artifacts_and_attached_chunks():
    for n in (1, 2):
        data = A.signed(document(n), keys(n))
        doc = A.decode(data)
        for s in doc["signatures"]:
            assert ed25519.verify(ed25519.raw_key(s["signer"]), A.signing_body(data), s["signature"])
        more = A.attached(data, "TIMESTAMP", {"authority": "tsa", "time_ms": 5, "token": b"t"})
        assert A.digest(more) == A.digest(data) and A.decode(more)["timestamp_anchor"]["time_ms"] == 5
        assert A.decode(A.attached(more, "TIMESTAMP", {"authority": "tsa", "time_ms": 6, "token": b""}))["timestamp_anchor"]["time_ms"] == 6


def kind(data: bytes) -> tuple:
    try:
        A.decode(data)
    except A.Invalid as e:
        return e.kind, e.stage
    return ()


def test_every_flipped_byte_is_found():
    data = A.signed(document(3), keys(1))
    for i in range(0, len(data), 7):
        assert kind(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]) != ()
    assert all(kind(data[:i]) for i in range(0, len(data), 13))


def rebuilt(data: bytes, change) -> bytes:
    parts = [(k, p) for k, _, p in A.chunks(data) if k != A.CHUNKS["CHECKSUM"]]
    return A.sealed(data[: len(A.MAGIC) + 2] + b"".join(A.chunk(k, p) for k, p in change(parts)))


def test_order_of_failures():
    data = A.signed(document(4), keys(1))
    assert kind(b"junk") == ("magic", 1) and kind(data[:9] + b"\x09" + data[10:]) == ("version", 2)
    assert kind(data[:11]) == ("format", 3) and kind(data + b"x") == ("format", 5)
    assert kind(rebuilt(data, lambda p: [*p, p[0]])) == ("format", 6)
    assert kind(rebuilt(data, lambda p: [*p, (A.CHUNKS["TASK"], cbor.encode({}))])) == ("format", 6)
    assert kind(rebuilt(data, lambda p: [*p, (A.CHUNKS["MULTISIG"], cbor.encode([]))])) == ("format", 7)
    assert kind(rebuilt(data, lambda p: [x for x in p if x[0] != A.CHUNKS["PAYLOAD"]])) == ("format", 10)
    assert kind(rebuilt(data, lambda p: [*p, (0x55, b"anything")])) == ()
    long = lambda p: [(k, b"\xbf" + x[1:] + b"\xff") if k == A.CHUNKS["PROVENANCE"] else (k, x) for k, x in p]
    assert kind(rebuilt(data, long)) == ("format", 11)  # not canonical, though signed
    assert kind(rebuilt(A.encode(document(4)), long)) == ()  # unsigned, so lenient


def test_graph_rules():
    r = random.Random(0)
    n = lambda i, *refs: {"id": i, "type": "fact", "value": 1, "confidence": distribution(r), "refs": list(refs)}
    bad = [[n("a"), n("a")], [n("a", "b")], [n("a", "b"), n("b", "a")], [n("a", "a")], [n("")], []]
    assert all(kind(A.encode({"payload": p})) == ("format", 10) for p in bad)
    assert kind(A.encode({"payload": [n("a", CROSS_DOCUMENT + "00#x")]})) == ()


def test_listing_of_broken_files():
    data = A.encode(document(5))
    assert [c["name"] for c in A.listing(data)][-1] == "CHECKSUM"
    assert A.listing(data[:40]) and A.listing(b"") == []
    assert struct.unpack(">B", data[9:10])[0] == A.VERSION
