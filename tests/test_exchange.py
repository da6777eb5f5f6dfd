"""Other spellings, imports and lists."""

import base64
import json

import pytest
from hypothesis import given, settings

from provspark.codec import artifact as A
from provspark.codec import exchange as X
from provspark.sources import lists as L
from tests.test_codec import VALUES, document, keys


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_values_round_trip(x):
    assert X.unplain(json.loads(json.dumps(X.plain(x)))) == x
    assert X.unpack(X.pack(x)) == x


def test_documents_round_trip():
    for seed in range(20):
        data = A.signed(document(seed), keys(1 + seed % 2))
        doc = A.decode(data)
        for to, back in ((X.to_json, X.from_json), (X.to_msgpack, X.from_msgpack)):
            again = back(to(doc))
            assert again == doc and A.encode(again) == data
        with pytest.raises(X.Mismatch):
            X.from_json(X.to_json(doc).replace('"m"', '"n"', 1))
        assert "n0" in X.rendered(doc)


@pytest.mark.parametrize("x,text", [(None, "c0"), (5, "05"), (-1, "ff"), (255, "ccff"), (-129, "d1ff7f"), ("a", "a161"), ([1], "9101"), ({"a": 1}, "81a16101"), (b"\x01", "c40101"), (1.5, "cb3ff8000000000000")])
def test_msgpack_examples(x, text):
    assert X.pack(x).hex() == text and X.unpack(bytes.fromhex(text)) == x


def test_imports():
    store = {"active_manifest": "b", "manifests": {"a": {}, "b": {"claim_generator": "tool/1", "title": "t", "assertions": [{"label": "x"}], "signature_info": {"issuer": "I", "time": "2024-01-01T00:00:00Z"}}}}
    doc = X.from_manifest(json.dumps(store))
    assert doc["provenance"]["timestamp_ms"] == 1704067200000 and doc["provenance"]["model_card"] == "c2pa:I"
    assert A.decode(A.encode(doc))["payload"][0]["value"]["title"] == "t"
    for bad in ({}, {"validation_state": "Invalid", "assertions": []}, []):
        with pytest.raises(ValueError):
            X.from_manifest(bad)
    doc = X.from_response("done", "m", [{"role": "user"}], 5, [{"name": "f", "call_id": "1"}], [{"call_id": "1", "content": "r", "is_error": False}], ["a", "b"], [0.5, 1.0])
    back = A.decode(A.encode(doc))
    assert [n["id"] for n in back["payload"]] == ["call_0", "result_0", "main"] and back["payload"][2]["refs"] == ["result_0"]
    assert back["payload"][2]["confidence"]["mean"] == 0.75 and back["trace"][1]["deps"] == ["thought_0"]


def test_keys_and_envelopes():
    from provspark.codec import ed25519, keys as K

    seeds = {n: bytes([i]) * 32 for i, n in enumerate("abc", 1)}
    public = {n: ed25519.public_key(s) for n, s in seeds.items()}
    records = [K.rotated(seeds[x], seeds[y], x, y, 5) for x, y in ("ab", "bc")]
    assert K.successors(records, public) == {"a": "c", "b": "c"}
    assert not K.rotation_ok(records[0] | {"timestamp_ms": 6}, public["a"], public["b"]) and not K.rotation_ok({}, public["a"], public["b"])
    assert K.successors([records[0] | {"new_key_proof": records[0]["proof"]}], public) == {}
    assert K.opened(K.envelope("c", "l", "m", b"x", b"y")) == ("c", "l", "m", b"x", b"y")
    for bad in (lambda: K.envelope("", "l", "m", b"x"), lambda: K.envelope("c", "l", "m", b""), lambda: K.opened({}), lambda: K.opened(K.envelope("c", "l", "m", b"x") | {K.ARTIFACT: "?"})):
        with pytest.raises(ValueError):
            bad()
    assert len(K.vector_fingerprint([0.1, -0.5] * 40)) == 16
    assert len(ed25519.seed_from_words("some words", rounds=1)) == 32


def test_lists(spark, tmp_path):
    good = {"artifact_digest": "d", "signer": "s", "issued_ms": 1, "reason": "other", "signature": base64.b64encode(b"x").decode()}
    write = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    a = write("a.json", json.dumps({"revocations": [good, good | {"issued_ms": True}, 7]}))
    b, c = write("b.json", "[]"), write("c.json", "{not json")
    rows, state = L.statements(L.files(spark, a).unionByName(L.files(spark, b)).unionByName(L.files(spark, c)))
    assert rows.count() == 1 and sorted((r.n_good, r.n_malformed, r.error) for r in state.collect()) == [(0, 0, "malformed"), (0, 0, "unreadable"), (1, 2, "")]
    with pytest.raises(L.Unreadable):
        L.load_statements(spark, a)
    L.save_statements(rows, str(tmp_path / "saved"))
    assert L.load_statements(spark, str(tmp_path / "saved")).collect() == rows.collect()
    assert L.load_signers(spark, write("s.json", '{"revoked": ["x", "y", "x"]}')).count() == 2
    assert L.load_revoked_keys(spark, write("k.json", '{"revoked": {"x": 5}}')).first()[:] == ("x", 5)
    assert L.load_roles(spark, write("r.json", '{"roles": {"a": ["x"], "b": []}}')).count() == 2
    for f, text in ((L.load_signers, '{"revoked": "x"}'), (L.load_revoked_keys, '{"revoked": {"x": true}}'), (L.load_roles, '{"roles": {"a": "x"}}')):
        with pytest.raises(L.Unreadable):
            f(spark, write("bad.json", text))
    assert L.revoked_names('{"revoked": {"a": 1}}') == ["a"] and L.revoked_names('["a", 2]') == ["a", "2"] and L.revoked_names("# no\n a \n\nb") == ["a", "b"]
    now, texts = [0.0], iter(["a", "b"])
    crl = L.Crl(lambda: next(texts), 10, lambda: now[0])
    assert crl.current() == ["a"]
    now[0] = 11
    assert crl.current() == ["b"]
    now[0] = 30
    assert crl.current() == ["b"]
    with pytest.raises(L.Unreadable):
        L.Crl(lambda: next(texts)).current()
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "k1.pub").write_bytes(b"k" * 32)
    assert L.load_keys(spark, str(tmp_path / "keys")).first()[:] == ("k1", base64.b64encode(b"k" * 32).decode())


def test_layouts_for_exchange():
    """MessagePack keeps all layers but task and roles; compact JSON keeps values as text and no signatures. Both notice a change."""
    from provspark.codec import layouts

    for seed in range(30):
        doc = A.decode(A.signed(document(seed), keys(1 + seed % 2)))
        packed = layouts.to_packed(doc)
        again = layouts.from_packed(packed)
        for layer in ("payload", "trace", "trace_method", "alternatives", "normalized", "delta", "signatures"):
            assert again[layer] == doc[layer], layer
        assert {k: again["provenance"][k] for k in layouts.SHORT_PROVENANCE} == {k: doc["provenance"][k] for k in layouts.SHORT_PROVENANCE}
        assert (again["semantic"] or {}).get("embedding") == (doc["semantic"] or {}).get("embedding")
        with pytest.raises((X.Mismatch, ValueError)):
            layouts.from_packed(packed[:-1] + bytes([packed[-1] ^ 1]))
        text = layouts.to_compact(doc)
        body = json.loads(text)
        assert body["fmt"] == "spif" and body["prov"]["m"] == "m" and len(body["payload"]) == len(doc["payload"]) and ("sem" in body) == bool(doc["semantic"])
        back = layouts.from_compact(text)
        assert [(n["id"], n["type"], n["value"], n["confidence"], n["refs"]) for n in back["payload"]] == [(n["id"], n["type"], n["value"] if isinstance(n["value"], str) else str(n["value"]), n["confidence"], n["refs"]) for n in doc["payload"]]
        assert back["trace"] == doc["trace"] and back["delta"] == (doc["delta"] and {"base_hash": "0" * 64, "changes": []}) and A.decode(A.encode(back))["payload"]
        with pytest.raises(X.Mismatch):
            layouts.from_compact(text.replace('"prov":{"m":"m"', '"prov":{"m":"n"'))
        with pytest.raises(X.Mismatch):
            layouts.from_compact("{}")
