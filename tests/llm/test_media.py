"""Texts as pictures: exact payloads and stable values."""

import hashlib
import zlib

import numpy as np

from provspark.llm import media as M
from provspark.llm import webp


def test_rows(spark):
    long = ("A line that comes again and again.\n" * 3000 + "é" * 70_000)[:150_000]
    texts = [None, "", "a", "x" * 64, "x" * 65, "ab" * 9, "Some words, then more words.\nSome words, then more words.\nend", long, "01" * 500, "a" * 64 + "b" * 64 + "c" * 64]
    rows = [*enumerate(texts), (2, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS feature")
    got = M.features(docs).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d, len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(M.stored(payload)).hexdigest() and r.media_bytes == len(M.stored(payload))
    assert len({tuple(r)[1:] for r in got if r.n_bytes == 1}) == 1
    arrays = M.pixel_arrays(M.pictures(docs)).collect()
    assert all(np.frombuffer(a.argb, "<u4").size == a.width * a.height and a.error is None for a in arrays)
    bad = spark.createDataFrame([(b"RIFF",), (None,)], "media binary")
    assert all(r.error and r.argb is None for r in M.pixel_arrays(bad).collect())
    assert M.features(docs.limit(0)).count() == 0


def test_long_payloads_become_several_files(monkeypatch):
    monkeypatch.setattr(M, "PART", 1 << 12)
    payload = M.payload_of(bytes(range(256)) * 60)
    media = M.stored(payload)
    assert media.count(b"RIFF") > 3 and M.read_back(media)[: len(payload)].tobytes() == payload


def test_prediction_is_taken_where_it_helps():
    ramp = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8).tobytes()
    media = M.stored(ramp)
    assert M.read_back(media).tobytes() == ramp and len(media) < 600
    wide = M.stored(bytes(64 * (1 << 15)))
    assert webp.decode(wide).shape == (1 << 14, 128)


def test_every_tool_of_the_reader_is_exercised(monkeypatch):
    """Over a few hundred payloads the writer takes every transform, predictor and coding tool; all come back."""
    seen = set()
    real = webp.encode

    def watched(pixels, transforms=(), cache=0, matches=()):
        for t in transforms:
            seen.add(t[0])
            if t[0] == "predictor":
                seen.update(f"mode {m}" for m in np.unique(t[1]).tolist())
        seen.update(["cache"] * bool(cache) + ["copies"] * bool(len(matches)))
        return real(pixels, transforms, cache, matches)

    monkeypatch.setattr(webp, "encode", watched)
    r = np.random.default_rng(1)
    letters = np.frombuffer(b"etaoin shrdlu,.cmfwyp\n\xc3\xa9", np.uint8)
    for n in [*r.integers(1, 240, 120), *r.integers(250, 1000, 120), *r.integers(1000, 9000, 40)]:
        text = r.choice(letters, n).tobytes()
        if n % 5 == 0:
            text = (text + b"\n") * 3
        payload = M.payload_of(text)
        assert M.read_back(M.stored(payload))[: len(payload)].tobytes() == payload
    for back in (63, 64, 65):  # each row is the one above, shifted by one
        line = r.integers(0, 256, back, np.uint8).tobytes()
        for end in range(20):
            payload = M.payload_of((line * 80)[: 64 * 60] + bytes([end]))
            assert M.read_back(M.stored(payload)).tobytes() == payload
    assert seen >= {"palette", "green", "cross", "predictor", "cache", "copies", *(f"mode {m}" for m in range(14))}
