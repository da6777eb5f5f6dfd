"""Artifacts as tables: trust, revocation, files, SQL functions and streams."""

import base64

import pytest

from provspark.codec import artifact as A
from provspark.codec import ed25519
from provspark.codec import stream as codec
from provspark.operators import graph, policy, replay
from provspark.sources import artifacts as S
from provspark.sources.datasource import register
from provspark.streaming import artifacts as streams
from tests.test_codec import document, keys

SEED = {i: bytes([i]) * 32 for i in (1, 2, 3)}
KEY = {i: base64.b64encode(ed25519.public_key(s)).decode() for i, s in SEED.items()}
signer = lambda i: (KEY[i], lambda m: ed25519.sign(SEED[i], m))


def revocation(data: bytes, i: int, forged: bool = False) -> dict:
    s = {"artifact_digest": A.digest(data), "signer": KEY[i], "issued_ms": 5, "reason": "retracted"}
    return s | {"signature": ed25519.sign(SEED[3 if forged else i], A.statement_bytes(s))}


@pytest.fixture(scope="module")
def files(spark):
    one, two = A.signed(document(1), [signer(1)]), A.signed(document(2), [signer(1), signer(2)])
    blank = A.signed(document(3), [(KEY[1], lambda m: bytes(64))])
    url = A.signed(document(4), [("https://keys.example/1", signer(1)[1])])
    rows = {"valid": one, "multi": two, "unsigned": A.encode(document(5)), "bad_signature": blank, "url": url, "tampered": one[:60] + b"\x00" + one[61:], "junk": b"junk", "null": None, "carries": A.attached(one, "REVOCATION", [revocation(one, 1)]), "forged": A.attached(two, "REVOCATION", [revocation(two, 1, True), revocation(one, 1)]), "zipped": A.encode(document(6), "zstd")}
    return spark.createDataFrame(list(rows.items()), "path string, content binary"), rows


def test_trust_report(spark, files):
    df, rows = files
    status = {r.artifact_id: r for r in S.trust_report(df, "path", "content").collect()}
    # A statement in one copy of an artifact counts for all that have its digest.
    want = {"valid": "REVOKED", "multi": "VALID", "unsigned": "UNSIGNED", "bad_signature": "INVALID", "url": "UNVERIFIABLE", "tampered": "INVALID", "junk": "INVALID", "null": "INVALID", "carries": "REVOKED", "forged": "VALID", "zipped": "UNSIGNED"}
    assert {k: r.trust_status for k, r in status.items()} == want
    assert status["forged"].forged_revocations == 1 and status["tampered"].error_class == "checksum" and status["junk"].error_class == "magic"
    known = spark.createDataFrame([("https://keys.example/1", KEY[1]), (KEY[2], "unusable")], "signer string, key_b64 string")
    again = {r.artifact_id: r.trust_status for r in S.trust_report(df, "path", "content", known).collect()}
    assert again["url"] == "VALID" and again["multi"] == "UNVERIFIABLE"
    r = revocation(rows["multi"], 2)
    told = spark.createDataFrame([tuple(r.values())], "artifact_digest string, signer string, issued_ms long, reason string, signature binary")
    assert {r.artifact_id: r.trust_status for r in S.trust_report(df, "path", "content", statements=told).collect()}["multi"] == "REVOKED"


def test_pinned_keys_held_or_joined(spark, files, monkeypatch):
    """With few pinned keys workers hold them, with many they are joined: the report is the same. Pinned signers' statements apply."""
    df, rows = files
    url = "https://keys.example/1"
    known = spark.createDataFrame([(url, KEY[1]), (KEY[2], "unusable")], "signer string, key_b64 string")
    s = {"artifact_digest": A.digest(rows["url"]), "signer": url, "issued_ms": 5, "reason": "retracted"}
    good, forged = ed25519.sign(SEED[1], A.statement_bytes(s)), ed25519.sign(SEED[2], A.statement_bytes(s))
    told = spark.createDataFrame([(*s.values(), x) for x in (good, good, forged, b"")] + [(None, None, None, None, None)], "artifact_digest string, signer string, issued_ms long, reason string, signature binary")
    columns = ["artifact_id", "trust_status", "revocations_applied", "forged_revocations", "n_signatures"]
    report = lambda: sorted(S.trust_report(df, "path", "content", known, told).select(*columns, "signatures").collect())
    held = report()
    by = {r.artifact_id: r for r in held}
    assert tuple(by["url"])[1:4] == ("REVOKED", 1, 2) and by["url"].signatures[0].basis == "pinned"
    monkeypatch.setattr(S, "HELD_KEYS", 1)
    joined = report()
    same = lambda rs: [(*r[:5], sorted(map(tuple, r.signatures or []))) for r in rs]
    assert same(joined) == same(held)


def test_hybrid_signatures(spark):
    key = base64.b64encode(ed25519.public_key(SEED[1]) + bytes(1952)).decode()
    doc = document(9)

    def made(algorithm, size, seed=SEED[1]):
        blank = {"slot": "single", "algorithm": algorithm, "signer": key, "signature": bytes(size), "key_id": ""}
        body = A.signing_body(A.encode(doc | {"signatures": [blank]}))
        return A.encode(doc | {"signatures": [blank | {"signature": (ed25519.sign(seed, body) + bytes(size))[:size]}]})

    rows = {"good": made("ed25519+ml-dsa-65", 3373), "short": made("ed25519+ml-dsa-65", 64), "bad": made("ed25519+ml-dsa-65", 3373, SEED[2]), "pq": made("ml-dsa-65", 3309), "pq_short": made("ml-dsa-65", 9), "other": made("rsa", 64)}
    df = spark.createDataFrame(list(rows.items()), "path string, content binary")
    status = lambda **k: {r.artifact_id: r.trust_status for r in S.trust_report(df, "path", "content", **k).collect()}
    want = {"good": "VALID", "short": "INVALID", "bad": "INVALID", "pq": "UNVERIFIABLE", "pq_short": "UNVERIFIABLE", "other": "UNVERIFIABLE"}
    assert status() == want and status(require_pq=True) == want | {"good": "UNVERIFIABLE", "pq_short": "INVALID"}


def test_event_time_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from provspark.operators import windows

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    figures = [F.count(F.lit(1)).alias("n")]
    rows = [[(at(1), 1.0), (at(9), 1.0), (at(12), 1.0)], [(at(50), 1.0)], [(at(120), 1.0)], [(at(121), 1.0)], [(at(2), 1.0)], [(at(300), 1.0)]]
    got = run_stream(spark, tmp_path, "timed", None, "ts timestamp, value double", lambda df: windows.tumbling(df, "ts", "10 minutes", [], figures, late="5 minutes"), rows)
    by = {r.window_start.minute + 60 * r.window_start.hour: r.n for r in got}
    assert by[0] == 2 and by[10] == 1 and by[50] == 1  # the late row is dropped


def test_bundle(spark):
    target = document(7)
    n = dict(document(8)["payload"][0], refs=[f"{A.CROSS_DOCUMENT}{A.content_id(target)}#{target['payload'][0]['id']}", f"{A.CROSS_DOCUMENT}{A.content_id(target)}#none"])
    df = spark.createDataFrame([("a", A.encode({"payload": [n]})), ("b", A.encode(target))], "path string, content binary")
    rows = S.decoded(df).filter("artifact_id = 'b'").selectExpr("content_id", "explode(payload.id) AS node_id")
    got = {r.artifact_id: r for r in S.trust_report(df, "path", "content", bundle=rows).collect()}
    assert (got["a"].refs_resolved, got["a"].refs_unresolved) == (1, 1)


def test_files_and_sql(spark, files, tmp_path):
    df, rows = files
    register(spark)
    S.write_files(df.filter("content IS NOT NULL"), str(tmp_path / "out"), "path")
    back = S.read(spark, str(tmp_path / "out"))
    assert {r.artifact_id.rsplit("/", 1)[1]: r.decode.ok for r in back.collect()} == {k: k not in ("tampered", "junk") for k, v in rows.items() if v is not None}
    strict = S.read(spark, str(tmp_path / "out"), require_signature=True)
    assert strict.filter("decode.error_class = 'signature'").count() == 2
    df.createOrReplaceTempView("files")
    got = spark.sql("SELECT path, artifact_error(content) AS e, artifact_digest(content) AS d, content_id(content) AS c FROM files WHERE content IS NOT NULL").collect()
    assert {r.path: r.e for r in got}["tampered"] == "checksum" and {r.path: r.d for r in got}["valid"] == A.digest(rows["valid"])
    assert spark.sql("SELECT count(*) FROM files, LATERAL artifact_nodes(content) WHERE path = 'valid'").first()[0] == len(document(1)["payload"])
    assert spark.sql("SELECT name FROM artifact_chunks(unhex('00'))").count() == 0
    assert spark.sql("SELECT dag_status(array('a', 'b'), array(array('b'), array('a'))) AS s, cbor_form(unhex('a2616201616101')) AS f, cbor_json(unhex('a16161c2410a')) AS j").first()[:] == ("cycle", "unsorted", '{"a":10}')


def stream(parts, value=None, **how) -> bytes:
    node = {"id": "main", "type": "text", "value": "".join(t for _, _, t in parts) if value is None else value, "confidence": document(1)["payload"][0]["confidence"], "refs": []}
    return codec.written({"payload": [node]}, parts, **how)


def test_stream_reader_in_any_cuts():
    data = stream([("main", 0, "hello "), ("main", 3, "world")])
    want = [e["event"] for e in codec.events_of(data)]
    assert want == ["opened", "partial_text", "partial_text", "verified"]
    for size in (1, 7, 64):
        reader, got = codec.Reader(), []
        for i in range(0, len(data), size):
            got += reader.feed(data[i : i + size])
        assert [e["event"] for e in got] == want and reader.feed(b"more") == []
    last = lambda d, **k: (r := codec.Reader(**k), r.feed(d))[1][-1]["event"]
    assert last(stream([("main", 1, "a"), ("main", 1, "b")])) == "error"
    assert last(stream([("main", 0, "a")], value="b")) == "error" and last(stream([("other", 0, "a")], value="a")) == "error"
    point = (2, b"h" * 32)
    resumed = stream([("main", 2, "end")], value="start end", resume=point)
    assert last(resumed) == "error" and last(resumed, any_resume=True) == "verified" and last(resumed, resume=point) == "verified" and last(resumed, resume=(3, b"h" * 32)) == "error"
    assert last(stream([("main", 1, "end")], value="end", resume=point), any_resume=True) == "error"
    assert codec.parsed_token(codec.token(*point)) == point and last(b"nonsense") == "error"


def run_stream(spark, tmp_path, name, rows, schema, f, batches):
    folder, out = tmp_path / name, []
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = f(source).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_structured_streams(spark, tmp_path):
    good, bad = stream([("main", 0, "a"), ("main", 1, "b")]), stream([("main", 1, "a"), ("main", 0, "b")])
    cut = lambda n, d: [(n, i, d[i * 50 : i * 50 + 50]) for i in range(-(-len(d) // 50))]
    a, b = cut("good", good), cut("bad", bad)
    got = run_stream(spark, tmp_path, "fragments", None, "stream_id string, frag_no long, data binary", lambda df: streams.follow(df, idle_ms=None), [a[1::-1] + b[:2], a[2:] + b[2:]])
    events = lambda n: [r.event for r in sorted(got, key=lambda r: r.event_no) if r.stream_id == n]
    assert events("good") == ["opened", "partial_text", "partial_text", "verified"] and events("bad") == ["opened", "partial_text", "error"]
    got = run_stream(spark, tmp_path, "steps", None, "stream_id string, step_no long, id string, deps array<string>", streams.growing_graphs, [[("s", 0, "a", ["c"]), ("s", 1, "b", ["a"])], [("s", 2, "c", ["b"]), ("s", 3, "c", [])]])
    assert {r.step_no: bool(r.error) for r in got} == {0: False, 1: False, 2: True, 3: False}
    got = run_stream(spark, tmp_path, "nonces", None, "nonce string, arrival long, signers array<string>", streams.fresh_only, [[("n", 0, ["a", "b"]), ("m", 1, ["a"])], [("n", 2, ["b", "c"]), ("n", 3, ["c"]), ("", 4, ["a"]), ("n", 5, []), ("n", 6, [])]])
    assert {r.arrival: r.status for r in got} == {0: "fresh", 1: "fresh", 2: "replay", 3: "fresh", 5: "fresh", 6: "replay"}


def test_folds(spark):
    rows = [(0, "n", ["a", "b"]), (1, "n", ["b"]), (2, "n", ["c"]), (3, "", ["a"]), (4, "n", []), (5, "n", []), (6, "n", [""])]
    got = replay.several(spark.createDataFrame(rows, "arrival long, nonce string, signers array<string>")).collect()
    assert {r.arrival: r.status for r in got} == {0: "fresh", 1: "replay", 2: "fresh", 3: "no_nonce", 4: "fresh", 5: "replay", 6: "fresh"}
    events = [(1, i, f"e{i}", t, [f"e{i - 1}"] if i else [], True, "verified") for i, t in enumerate(policy.EVENT_TYPES)]
    events += [(2, *e[1:]) for e in events[:2]] + [(2, 2, "e2", "PolicyEvaluation", ["e1", "e1"], True, "verified"), (2, 3, "e3", "Review", ["e2"], True, "verified"), (2, 4, "e4", "Decision", [], True, "verified"), (2, 5, "e5", "Evidence", ["e1"], True, "verified"), (2, 6, "e6", "Action", ["e1"], False, "revoked_signer")]
    df = policy.governed(spark.createDataFrame(events, "chain_id long, pos long, event_id string, event_type string, parent_ids array<string>, valid boolean, reason string"))
    assert [r.reason for r in sorted(df.filter("chain_id = 2").collect(), key=lambda r: r.pos)] == ["verified", "verified", "duplicate_parent", "missing_parent", "invalid_root", "parent_order", "revoked_signer"]
    summary = {r.chain_id: (r.failures, r.complete) for r in policy.chain_summary(df).collect()}
    assert summary == {1: (0, True), 2: (5, False)}


def test_graphs():
    assert graph.in_row_stuck(["a", "b", "c", "d"], [["b"], ["a"], ["a"], []]) == ["a", "b", "c"]
    assert graph.declared_depth(["a", "b", "c"], [["c"], ["a"], []]) == {"a": 1, "b": 2, "c": 0}
    g = graph.Incremental()
    assert g.add("a", ["b"]) is None and g.add("b", ["c"]) is None and "cycle" in g.add("c", ["a"]) and g.add("c", []) is None and "duplicate" in g.add("a", [])
    assert keys(1)
