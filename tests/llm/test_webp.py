"""Lossless WebP: round trips through every transform and coding tool, and a hand-made stream."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import webp as W

RNG = np.random.default_rng(7)


def picture(h, w, colours=0, smooth=False):
    if smooth:
        y, x = np.mgrid[:h, :w]
        parts = np.stack([3 * x + y, 2 * y + x, x * y // 5, 255 - x // 4], -1) + RNG.integers(0, 3, (h, w, 4))
        return W.joined(parts & 255)
    if colours:
        return RNG.integers(0, 1 << 32, colours, np.uint64).astype(np.uint32)[RNG.integers(0, colours, (h, w))]
    return RNG.integers(0, 1 << 32, (h, w), np.uint64).astype(np.uint32)


def same(p, **how):
    assert (W.decode(W.encode(p, **how)) == p).all()


@pytest.mark.parametrize("h,w", [(1, 1), (1, 40), (50, 1), (37, 61), (130, 129)])
def test_plain(h, w):
    for p in (picture(h, w), picture(h, w, 5), picture(h, w, 700), picture(h, w, smooth=True), np.zeros((h, w), np.uint32)):
        same(p)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    p = picture(23, 37, smooth=True)
    same(p, transforms=(("predictor", np.full((6, 10), mode), 2),))


def test_mixed_predictors_cross_and_green():
    p = picture(40, 66, smooth=True)
    modes, tiles = RNG.integers(0, 14, (10, 17)), picture(5, 9) | 0xFF000000
    same(p, transforms=(("predictor", modes, 2), ("cross", tiles, 3), ("green",)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 16, 17, 200, 256])
def test_palettes(n):
    p = picture(19, 45, n)
    same(p, transforms=(("palette", np.unique(p)),))


@pytest.mark.parametrize("cache", [0, 1, 5, 11])
def test_cache_and_copies(cache):
    p = picture(60, 50, 90)
    p[20:40] = p[:20]
    p[45:48] = p[0, 0]
    flat = p.ravel()
    same(p, cache=cache)
    matches = W.cut_up([(20 * 50, 20 * 50, 20 * 50), *W.runs(flat)])
    assert len(matches) > 1
    same(p, cache=cache, matches=matches)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(0, 4))
def test_any_bytes(data, cache):
    p = np.frombuffer(data, np.uint8).astype(np.uint32)[None] << 8 | 0xFF000000
    same(p, cache=cache)


def test_long_picture_in_stretches():
    p = (RNG.geometric(0.1, (4000, 64)) % 256).astype(np.uint32) << 8 | 0xFF000000
    same(p)
    same(picture(300, 300), cache=3)


def test_two_groups_of_codes():
    """Tiles of 4 x 4 pixels, written by hand: the left tile's green is always 7, the right one's 9 or 200."""
    out = W.Out()
    for v, n in ((0x2F, 8), (7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.put(v, n)
    W.write_pixels(out, np.array([0, 1 << 8], np.uint32) | 0xFF000000, 2)
    for greens in ((7,), (9, 200)):
        counts = np.zeros(280, np.int64)
        counts[list(greens)] = 1
        codes, _ = W.write_code(out, counts)
        for value in (1, 2, 255):
            one = np.zeros(256, np.int64)
            one[value] = 1
            W.write_code(out, one)
        W.write_code(out, np.zeros(40, np.int64))
    want = np.full((4, 8), 7)
    want[:, 4:] = RNG.choice([9, 200], (4, 4))
    for y in range(4):
        for x in range(4, 8):
            out.put(int(codes[want[y, x]]), 1)
    body = out.bytes()
    data = b"RIFF\0\0\0\0WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert (W.decode(data) == (want << 8 | 1 << 16 | 2 | 255 << 24)).all()


def test_broken_files():
    good = W.encode(picture(9, 9))
    for bad in (b"", good[:30], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises((W.Corrupt, IndexError, ValueError)):
            W.decode(bad)
