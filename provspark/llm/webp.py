"""Lossless WebP (RFC 9649): a complete decoder and an encoder, on numpy arrays.

Decoding a prefix code looks sequential, but which symbol would begin at a bit depends on the bits
alone. parse() therefore finds, for all bits of a stretch at once, where the pixel that would begin there
ends, follows that chain by doubling, and so never loops over pixels. Only pictures with several groups of
prefix codes are read symbol by symbol. Pixels are 32-bit ARGB numbers.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

GREEN, LENGTHS, DISTANCES, BYTES = 256, 24, 40, 256
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000
#: Fixed values of the format: the order of code length codes, and the multiplier of the colour cache's hash.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = 0x1E35A7BD
#: Bits that one stretch of parse() looks at.
STRETCH = 1 << 20
#: A chain of pixels is followed 2 ** HOPS pixels at a time.
HOPS = 2
_EIGHT = np.arange(8)


def near_distances() -> list[tuple[int, int]]:
    """The 120 short distances as (columns to the left, rows up): nearest first, then by column, left before right."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


NEAR = near_distances()


class Corrupt(ValueError):
    """Not a lossless WebP picture that can be read whole."""


# --- bits and prefix codes, reading


class Bits:
    """Little-endian bits of a buffer, from a place on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        x = int.from_bytes(self.data[a:b], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        if self.at > self.end:
            raise Corrupt("ends early")
        return x


_NO_BITS = np.zeros(1, np.int64)


class Code:
    """A prefix code as tables over its next bits: symbol and length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.nonzero(lengths)[0]
        if len(used) < 2:
            # A single symbol takes no bits.
            self.bits, self.width, self.symbol = 0, _NO_BITS, np.array([used[0] if len(used) else 0])
            return
        widths = lengths[used].astype(np.int64)
        if (1 << (15 - widths)).sum() != 1 << 15:
            raise Corrupt("a prefix code isn't complete")
        self.bits = int(widths.max())
        self.symbol = np.zeros(1 << self.bits, np.int64)
        self.width = np.zeros(1 << self.bits, np.int64)
        order = np.lexsort((used, widths))
        # In canonical order the codes fill the numbers of self.bits bits from the left.
        spans = 1 << (self.bits - widths[order])
        upside = np.repeat(used[order], spans), np.repeat(widths[order], spans)
        turned = reversed_bits(self.bits)
        self.symbol[turned], self.width[turned] = upside

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbol[0])
        at = bits.at
        k = (int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & (1 << self.bits) - 1
        bits.at += int(self.width[k])
        if bits.at > bits.end:
            raise Corrupt("ends early")
        return int(self.symbol[k])


_TURNED: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    """Each number below 2 ** n with its n bits in reverse."""
    if n not in _TURNED:
        x, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
        for i in range(n):
            out |= (x >> i & 1) << (n - 1 - i)
        _TURNED[n] = out
    return _TURNED[n]


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        n = bits.read(1) + 1
        symbols = [bits.read(8 if bits.read(1) else 1), *([bits.read(8)] if n == 2 else [])]
        if max(symbols) >= size:
            raise Corrupt("no such symbol")
        lengths[symbols] = 1
        return Code(lengths)
    kinds = np.zeros(19, np.uint8)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        kinds[k] = bits.read(3)
    of = Code(kinds)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        k = of.read(bits)
        if k < 16:
            lengths[at] = k
            last, at = k or last, at + 1
            continue
        n = bits.read(2) + 3 if k == 16 else bits.read(3) + 3 if k == 17 else bits.read(7) + 11
        if at + n > size:
            raise Corrupt("too many code lengths")
        if k == 16:
            lengths[at : at + n] = last
        at += n
    return Code(lengths)


def read_group(bits: Bits, cache: int) -> list[Code]:
    """Codes of green, red, blue, alpha and distance."""
    return [read_code(bits, n) for n in (GREEN + LENGTHS + (1 << cache if cache else 0), BYTES, BYTES, BYTES, DISTANCES)]


def prefix_value(symbol: int, bits: Bits) -> int:
    """A length or distance code from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- pictures, reading


def read_pixels(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded picture as a flat array. Only the main one can have several groups of codes."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise Corrupt("the colour cache is too large")
    tiles, step = None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        tiles = (read_pixels(bits, (width + (1 << step) - 1) >> step, (height + (1 << step) - 1) >> step) >> 8 & 0xFFFF).astype(np.int64)
    groups = [read_group(bits, cache) for _ in range(int(tiles.max()) + 1 if tiles is not None else 1)]
    if len(groups) > 1:
        return by_symbol(bits, groups, tiles, step, width, height, cache)
    return rebuild(*parse(bits, groups[0], width * height), width, width * height, cache)


def parse(bits: Bits, codes: list[Code], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of total pixels: green symbols; ARGB of literals or distance codes; pixels of each."""
    raw = np.frombuffer(bits.data, np.uint8)
    symbols, values, counts, done = [], [], [], 0
    tables = [(c.width, c.symbol, (1 << c.bits) - 1) for c in codes]
    if not any(c.bits for c in codes[:4]) and codes[0].symbol[0] < GREEN:
        colour = literal([int(c.symbol[0]) for c in codes[:4]])
        return np.full(total, codes[0].symbol[0]), np.full(total, colour, np.int64), np.ones(total, np.int64)
    while done < total:
        base = bits.at >> 3
        part = np.concatenate([raw[base : base + STRETCH // 8 + 32], np.zeros(36, np.uint8)]).astype(np.int64)
        whole = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16
        window = (whole[:, None] >> _EIGHT).ravel()
        n = len(window)
        width, symbol, mask0 = tables[0]
        index = window & mask0
        end = width.take(index)
        end += np.arange(n)
        top = n - 1
        nxt = end
        for (width, _, mask), code in zip(tables[1:4], codes[1:4]):
            if code.bits:
                nxt = np.minimum(nxt, top)
                nxt = nxt + width.take(window.take(nxt) & mask)
        if (symbol >= GREEN).any():
            green = symbol.take(index)
            odd = np.nonzero(green >= GREEN)[0]
            nxt = nxt.copy() if nxt is end else nxt
            nxt[odd] = end[odd]
            refs = odd[green[odd] < GREEN + LENGTHS]
            if len(refs):
                nxt[refs] = reference(window, end[refs], green[refs] - GREEN, tables[4])[0]
        # A stretch's pixels must end well before its last bits, which may lack what follows.
        limit = STRETCH if base + STRETCH // 8 + 32 < len(raw) else 8 * (len(raw) - base)
        nxt = np.minimum(nxt, top)
        hops = [nxt]
        for _ in range(HOPS):
            hops.append(hops[-1].take(hops[-1]))
        far, at, places = memoryview(hops[-1]), bits.at & 7, []
        for _ in range(((total - done) >> HOPS) + 1):
            if at >= limit:
                break
            places.append(at)
            at = far[at]
        at = np.array(places, np.int64)
        for hop in hops[-2::-1]:
            at = np.stack([at, hop.take(at)], 1).ravel()
        at = at[(at < limit)]
        if not len(at):
            raise Corrupt("ends early")
        got = symbol.take(window.take(at) & mask0)
        value = np.zeros(len(at), np.int64)
        count = np.ones(len(at), np.int64)
        lit = got < GREEN
        if lit.all():
            lit = slice(None)
        p, colour = end.take(at[lit]), got[lit] << 8
        for (width, sym, mask), shift in zip(tables[1:4], (16, 0, 24)):
            if mask:
                k = window.take(np.minimum(p, top)) & mask
                colour |= sym.take(k) << shift
                p = p + width.take(k)
            elif sym[0]:
                colour |= int(sym[0]) << shift
        value[lit] = colour
        ref = (got >= GREEN) & (got < GREEN + LENGTHS)
        if ref.any():
            _, count[ref], value[ref] = reference(window, end[at[ref]], got[ref] - GREEN, tables[4])
        upto = np.cumsum(count)
        keep = int(np.searchsorted(upto, total - done)) + 1
        got, value, count, at = got[:keep], value[:keep], count[:keep], at[:keep]
        symbols.append(got)
        values.append(value)
        counts.append(count)
        done += int(upto[min(keep, len(upto)) - 1])
        bits.at = 8 * base + int(nxt[at[-1]])
        if bits.at > bits.end:
            raise Corrupt("ends early")
    return np.concatenate(symbols), np.concatenate(values), np.concatenate(counts)


def literal(parts: list[int]) -> int:
    g, r, b, a = parts
    return a << 24 | r << 16 | g << 8 | b


def reference(window: np.ndarray, at: np.ndarray, prefix: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For back-references whose green symbols end at at: where they end, their lengths and distance codes."""
    width, symbol, mask = table
    top = len(window) - 1
    sixteen = lambda p: window[np.minimum(p, top)] & 0xFFFF

    def value(prefix: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.maximum((prefix - 2) >> 1, 0)
        # There are 18 extra bits at most, and a window holds 17.
        bits = (sixteen(p) | sixteen(p + 16) << 16) & (1 << extra) - 1
        base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
        return base + bits + 1, p + extra

    count, p = value(prefix, at)
    k = window[np.minimum(p, top)] & mask
    code, p2 = value(symbol[k], p + width[k])
    return p2, count, code


def rebuild(symbols: np.ndarray, values: np.ndarray, counts: np.ndarray, width: int, total: int, cache: int) -> np.ndarray:
    """Pixels from tokens."""
    begin = np.cumsum(counts) - counts
    refs = np.nonzero((symbols >= GREEN) & (symbols < GREEN + LENGTHS))[0]
    hits = np.nonzero(symbols >= GREEN + LENGTHS)[0]
    out = np.zeros(int(counts.sum()), np.uint32)
    if int(counts.sum()) != total:
        raise Corrupt("a copy goes past the end")
    if len(hits) and len(refs):
        return with_cache(symbols.tolist(), values.tolist(), counts.tolist(), out, width, cache)
    plain = np.nonzero(symbols < GREEN)[0]
    out[begin[plain]] = values[plain]
    for k in refs:
        copy(out, int(begin[k]), int(counts[k]), distance(int(values[k]), width))
    if len(hits):
        # A hit repeats the last literal before it that has its hash.
        own = hashed(values[plain].astype(np.uint32), cache)
        key = np.concatenate([own, symbols[hits] - GREEN - LENGTHS])
        place = np.concatenate([plain, hits])
        source = np.concatenate([np.arange(len(plain)), np.full(len(hits), -1)])
        order = np.lexsort((place, key))
        last = np.where(source[order] >= 0, np.arange(len(order)), -1)
        last = np.maximum.accumulate(last)
        same = (last >= 0) & (key[order][np.maximum(last, 0)] == key[order])
        colour = np.where(same, values[plain][source[order][np.maximum(last, 0)]] if len(plain) else 0, 0)
        is_hit = source[order] < 0
        out[begin[place[order][is_hit]]] = colour[is_hit]
    return out


def copy(out: np.ndarray, at: int, n: int, back: int) -> None:
    """Repeat what lies back pixels before, which may overlap itself."""
    if back > at:
        raise Corrupt("a copy begins before the picture")
    if back >= n:
        out[at : at + n] = out[at - back : at - back + n]
    else:
        out[at : at + n] = np.resize(out[at - back : at], n)


def hashed(colours: np.ndarray, cache: int) -> np.ndarray:
    return (colours.astype(np.uint64) * np.uint64(CACHE_HASH) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache)


def with_cache(symbols: list[int], values: list[int], counts: list[int], out: np.ndarray, width: int, cache: int) -> np.ndarray:
    """rebuild() where a cache and copies depend on each other: token by token."""
    slots, at, shift = [0] * (1 << cache), 0, 32 - cache
    for s, v, n in zip(symbols, values, counts):
        if GREEN <= s < GREEN + LENGTHS:
            copy(out, at, n, distance(v, width))
            for c, k in zip(out[at : at + n].tolist(), hashed(out[at : at + n], cache).tolist()):
                slots[k] = c
        else:
            if s >= GREEN:
                v = slots[s - GREEN - LENGTHS]
            out[at] = v
            slots[(v * CACHE_HASH & 0xFFFFFFFF) >> shift] = v
        at += n
    return out


def by_symbol(bits: Bits, groups: list[list[Code]], tiles: np.ndarray, step: int, width: int, height: int, cache: int) -> np.ndarray:
    """A picture whose prefix codes change from tile to tile."""
    across, total = (width + (1 << step) - 1) >> step, width * height
    out, slots, at = np.zeros(total, np.uint32), [0] * (1 << cache if cache else 1), 0
    kept = lambda c: slots.__setitem__((c * CACHE_HASH & 0xFFFFFFFF) >> (32 - cache), c) if cache else None
    while at < total:
        y, x = divmod(at, width)
        codes = groups[tiles[(y >> step) * across + (x >> step)]]
        s = codes[0].read(bits)
        if GREEN <= s < GREEN + LENGTHS:
            n = prefix_value(s - GREEN, bits)
            back = distance(prefix_value(codes[4].read(bits), bits), width)
            if at + n > total:
                raise Corrupt("a copy goes past the end")
            copy(out, at, n, back)
            for c in out[at : at + n].tolist() if cache else ():
                kept(c)
            at += n
            continue
        c = literal([s, *(code.read(bits) for code in codes[1:4])]) if s < GREEN else slots[s - GREEN - LENGTHS]
        out[at] = c
        kept(c)
        at += 1
    return out


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels of a lossless WebP file, height by width."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupt("not WebP")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise Corrupt("no lossless picture")
        size = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + size + size % 2
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise Corrupt("no signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Corrupt("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Corrupt("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            step = bits.read(3) + 2
            across = (now + (1 << step) - 1) >> step
            tiles = read_pixels(bits, across, (height + (1 << step) - 1) >> step).reshape(-1, across)
            undo.append((predictors_undone if kind == PREDICTOR else cross_undone, (tiles, step)))
        elif kind == SUBTRACT_GREEN:
            undo.append((green_added, ()))
        else:
            n = bits.read(8) + 1
            table = summed(read_pixels(bits, n, 1))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((coloured, (table, pack, now)))
            now = (now + (1 << pack) - 1) >> pack
    out = read_pixels(bits, now, height, main=True).reshape(height, now)
    for f, args in reversed(undo):
        out = f(out, *args)
    return out


# --- transforms, undone


def split(pixels: np.ndarray) -> np.ndarray:
    """The four bytes of pixels along a new last axis: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4").reshape(parts.shape[:-1]).astype(np.uint32)


def summed(table: np.ndarray) -> np.ndarray:
    """A palette from its differences."""
    return joined(np.cumsum(split(table), axis=0, dtype=np.uint8))


def coloured(pixels: np.ndarray, table: np.ndarray, pack: int, width: int) -> np.ndarray:
    """Palette indices, several to a green byte if the palette is small, to colours; indices beyond it are transparent."""
    index = (pixels >> 8 & 0xFF).astype(np.int64)
    if pack:
        size = 8 >> pack
        index = (index[:, :, None] >> np.arange(0, 8, size) & (1 << size) - 1).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def green_added(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 0xFF
    return pixels & 0xFF00FF00 | (pixels & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF


def spread(tiles: np.ndarray, step: int, height: int, width: int) -> np.ndarray:
    """Each pixel's tile."""
    return tiles.repeat(1 << step, 0)[:height].repeat(1 << step, 1)[:, :width]


def cross_delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8).astype(np.int32) >> 5


def cross_undone(pixels: np.ndarray, tiles: np.ndarray, step: int) -> np.ndarray:
    parts, by = split(pixels), split(spread(tiles, step, *pixels.shape))
    blue, green, red = (parts[..., i].copy() for i in range(3))
    red = (red + cross_delta(by[..., 0], green)).astype(np.uint8)
    blue = (blue + cross_delta(by[..., 1], green)).astype(np.uint8)
    blue = (blue + cross_delta(by[..., 2], red)).astype(np.uint8)
    return joined(np.stack([blue, green, red, parts[..., 3]], -1))


def mean(a, b):
    return (a + b) >> 1


def select(left, top, corner):
    to_left, to_top = abs(top - corner).sum(-1), abs(left - corner).sum(-1)
    return np.where((to_left < to_top)[..., None], left, top)


def half(a, b):
    d = a - b
    return np.clip(a + np.where(d < 0, -(-d // 2), d // 2), 0, 255)


#: A pixel's prediction by mode from the left, top, top right and top left ones, as arrays of four channels.
PREDICTIONS = (
    lambda l, t, r, c: np.broadcast_to(np.array([0, 0, 0, 255]), t.shape),
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: mean(mean(l, r), t),
    lambda l, t, r, c: mean(l, c),
    lambda l, t, r, c: mean(l, t),
    lambda l, t, r, c: mean(c, t),
    lambda l, t, r, c: mean(t, r),
    lambda l, t, r, c: mean(mean(l, c), mean(t, r)),
    lambda l, t, r, c: select(l, t, c),
    lambda l, t, r, c: np.clip(l + t - c, 0, 255),
    lambda l, t, r, c: half(mean(l, t), c),
)
#: Modes that look at the row above only.
FROM_ABOVE = (0, 2, 3, 4, 8, 9)


def neighbours(out: np.ndarray, y: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pixels a to b of row y: top, top right (beyond the last column, the row's own first pixel) and top left."""
    above = np.concatenate([out[y - 1], out[y, :1]])
    return above[a:b], above[a + 1 : b + 1], above[a - 1 : b - 1]


def predictors_undone(pixels: np.ndarray, tiles: np.ndarray, step: int) -> np.ndarray:
    rest = split(pixels).astype(np.int32)
    height, width = pixels.shape
    modes = tiles >> 8 & 0xF
    out = np.zeros_like(rest)
    first = rest[0].copy()
    first[0, 3] += 255
    out[0] = np.cumsum(first, 0) & 255
    out[1:, 0] = (np.cumsum(np.concatenate([out[0, :1], rest[1:, 0]]), 0) & 255)[1:]
    if not len(modes) or width == 1:
        return joined(out)
    if (modes == 2).all():
        # Each column is a running sum.
        out[1:, 1:] = (np.cumsum(np.concatenate([out[:1, 1:], rest[1:, 1:]]), 0) & 255)[1:]
        return joined(out)
    for y in range(1, height):
        for k, mode in enumerate(modes[y >> step].tolist()):
            a, b = max(1, k << step), min(width, (k + 1) << step)
            if a >= b:
                continue
            top, right, corner = neighbours(out, y, a, b)
            if mode in FROM_ABOVE or mode > 13:
                out[y, a:b] = rest[y, a:b] + PREDICTIONS[mode if mode <= 13 else 0](None, top, right, corner) & 255
            elif mode == 1:
                out[y, a:b] = (np.cumsum(np.concatenate([out[y, a - 1 : a], rest[y, a:b]]), 0) & 255)[1:]
            else:
                f, left = PREDICTIONS[mode], out[y, a - 1]
                for i in range(b - a):
                    left = rest[y, a + i] + f(left, top[i], right[i], corner[i]) & 255
                    out[y, a + i] = left
    return joined(out)


# --- bits and prefix codes, writing


class Out:
    """Numbers and their widths in bits, in the order of the file."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.loose: list[tuple[int, int]] = []

    def put(self, value: int, width: int) -> None:
        self.loose.append((value, width))

    def extend(self, values: np.ndarray, widths: np.ndarray) -> None:
        if self.loose:
            v, w = zip(*self.loose)
            self.values.append(np.array(v, np.int64))
            self.widths.append(np.array(w, np.int64))
            self.loose = []
        self.values.append(values.astype(np.int64))
        self.widths.append(widths.astype(np.int64))

    def bytes(self) -> bytes:
        self.extend(np.empty(0), np.empty(0))
        values, widths = np.concatenate(self.values), np.concatenate(self.widths)
        end = np.cumsum(widths)
        total = int(end[-1]) if len(end) else 0
        at = end - widths
        # Each number of up to 21 bits, shifted by up to 31, is exact as a float; sums of disjoint bits are as well.
        word, moved = at >> 5, (values << (at & 31)).astype(np.float64)
        n = (total >> 5) + 3
        sums = np.bincount(word, moved, n).astype(np.uint64)
        sums[1:] += sums[:-1] >> np.uint64(32)
        return (sums & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()[: (total + 7) // 8]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a Huffman code for the counts, of most bits at most; ties go by symbol."""
    used = np.nonzero(counts)[0].tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            w, i = heapq.heappop(heap)
            v, j = heap[0]
            up[i] = up[j] = n
            heapq.heapreplace(heap, (w + v, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        weights = [(w + 1) // 2 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of lengths, with their first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.nonzero(lengths)[0]
    if len(used) > 1:
        order = used[np.lexsort((used, lengths[used]))]
        widths = lengths[order]
        starts = np.cumsum(1 << (15 - widths)) - (1 << (15 - widths))
        codes[order] = reversed_bits(15)[starts]
    return codes


def write_code(out: Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the prefix code for symbols that occur so often; returns their codes and lengths."""
    used = np.nonzero(counts)[0].tolist() or [0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 2 and max(used) < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(int(wide), 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
            lengths[used] = 1
        return codes_of(lengths), lengths
    lengths = code_lengths(counts, 15)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    row = lengths[: used[-1] + 1].tolist()
    gap = 0
    for x in row:
        if not x:
            gap += 1
            continue
        while gap > 10:
            n = min(gap, 138)
            tokens.append((18, n - 11, 7))
            gap -= n
        if gap > 2:
            tokens.append((17, gap - 3, 3))
            gap = 0
        tokens += [(0, 0, 0)] * gap
        tokens.append((x, 0, 0))
        gap = 0
    kinds = np.bincount([t[0] for t in tokens], minlength=19)
    widths = code_lengths(kinds, 7)
    codes = codes_of(widths).tolist()
    last = max(i for i, k in enumerate(LENGTH_ORDER) if widths[k])
    n = max(4, last + 1)
    out.put(0, 1)
    out.put(n - 4, 4)
    for k in LENGTH_ORDER[:n]:
        out.put(int(widths[k]), 3)
    out.put(1, 1)  # the number of tokens follows, so no zeros are needed at the end
    limit = max(0, len(tokens) - 2)
    size = max(2, limit.bit_length() + limit.bit_length() % 2)
    out.put((size - 2) // 2, 3)
    out.put(limit, size)
    single = int((widths > 0).sum()) == 1
    for k, extra, bits in tokens + [(0, 0, 0)] * (2 - len(tokens)):
        out.put(codes[k], 0 if single else int(widths[k]))
        if bits:
            out.put(extra, bits)
    if int((lengths > 0).sum()) == 1:
        lengths = np.zeros(len(counts), np.int64)
    return codes_of(lengths), lengths


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra values and extra bits of lengths or distance codes."""
    v = np.asarray(values, np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return symbol, v - np.where(v < 4, v, (2 + (symbol & 1)) << extra), extra


# --- pictures, writing

Matches = list[tuple[int, int, int]]


def runs(pixels: np.ndarray, least: int = 8) -> Matches:
    """(place, length, 1) of pixels that repeat the one before."""
    same = np.concatenate([[False], pixels[1:] == pixels[:-1], [False]])
    edge = np.nonzero(same[1:] != same[:-1])[0]
    return [(a + 1, b - a, 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def cut_up(matches: Matches, most: int = 4096) -> Matches:
    """In order, without overlaps, none longer than the format allows."""
    out, free = [], 0
    for at, n, back in sorted(matches):
        if at < free:
            at, n = free, n - (free - at)
        while n > 3:
            m = min(n, most)
            out.append((at, m, back))
            at, n = at + m, n - m
        free = max(free, at)
    return out


def write_pixels(out: Out, pixels: np.ndarray, width: int, cache: int = 0, matches: Matches = (), main: bool = False) -> None:
    """An entropy-coded picture with one group of prefix codes."""
    pixels = pixels.ravel()
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    if main:
        out.put(0, 1)
    if matches:
        taken = np.zeros(len(pixels), bool)
        for at, n, _ in matches:
            taken[at : at + n] = True
        lit = np.nonzero(~taken)[0]
    else:
        lit = np.arange(len(pixels))
    green = (pixels[lit] >> 8 & 0xFF).astype(np.int64)
    hit = np.zeros(len(lit), bool)
    if cache:
        key = hashed(pixels, cache)
        order = np.argsort(key, kind="stable")
        before = np.full(len(pixels), -1)
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        hit = (before[lit] >= 0) & (pixels[before[lit]] == pixels[lit])
        green[hit] = GREEN + LENGTHS + key[lit[hit]]
    plain = pixels[lit[~hit]] if cache or matches else pixels
    counts = [np.bincount(green, minlength=GREEN + LENGTHS + (1 << cache if cache else 0))]
    every, some = (int(f.reduce(plain)) if len(plain) else 0 for f in (np.bitwise_and, np.bitwise_or))
    for shift in (16, 0, 24):
        if (every ^ some) >> shift & 0xFF:
            counts.append(np.bincount(plain >> shift & 0xFF, minlength=BYTES))
        else:  # one value throughout
            counts.append(np.zeros(BYTES, np.int64))
            counts[-1][every >> shift & 0xFF] = len(plain)
    if matches:
        at, n, back = np.array(matches, np.int64).T
        near = {max(1, x + y * width): i for i, (x, y) in reversed(list(enumerate(NEAR, 1)))}
        count, back = prefixed(n), prefixed(np.array([near.get(b, b + len(NEAR)) for b in back.tolist()]))
        counts[0] += np.bincount(GREEN + count[0], minlength=len(counts[0]))
        counts.append(np.bincount(back[0], minlength=DISTANCES))
    else:
        counts.append(np.zeros(DISTANCES, np.int64))
    codes = [write_code(out, c) for c in counts]
    tables = [(c, w) for c, w in codes]
    if not matches and not any(t[1].any() for t in tables[1:4]):
        out.extend(tables[0][0].take(green), tables[0][1].take(green))
        return
    order = np.concatenate([lit, at]) if matches else lit
    values, widths = np.zeros((len(order), 4), np.int64), np.zeros((len(order), 4), np.int64)
    put = lambda rows, k, table, symbols: (values.__setitem__((rows, k), table[0][symbols]), widths.__setitem__((rows, k), table[1][symbols]))
    put(slice(0, len(lit)), 0, tables[0], green)
    rows = np.nonzero(~hit)[0]
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        if tables[k][1].any():
            put(rows, k, tables[k], (plain >> shift & 0xFF).astype(np.int64))
    if matches:
        m = slice(len(lit), None)
        put(m, 0, tables[0], GREEN + count[0])
        values[m, 1], widths[m, 1] = count[1], count[2]
        put(m, 2, tables[4], back[0])
        values[m, 3], widths[m, 3] = back[1], back[2]
        rank = np.argsort(order, kind="stable")
        values, widths = values[rank], widths[rank]
    used = widths.any(0)
    out.extend(values[:, used].ravel(), widths[:, used].ravel())


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, modulo 256."""
    return joined(split(a) - split(b))


def predicted(pixels: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    """What predictors_undone() undoes; modes by tile."""
    parts, (height, width) = split(pixels).astype(np.int32), pixels.shape
    guess = np.zeros_like(parts)
    guess[0, 0, 3] = 255
    guess[0, 1:], guess[1:, 0] = parts[0, :-1], parts[:-1, 0]
    for y in range(1, height):
        for k, mode in enumerate(modes[y >> step].tolist()):
            a, b = max(1, k << step), min(width, (k + 1) << step)
            if a < b:
                guess[y, a:b] = PREDICTIONS[mode](parts[y, a - 1 : b - 1], *neighbours(parts, y, a, b))
    return joined(parts - guess & 255)


def crossed(pixels: np.ndarray, tiles: np.ndarray, step: int) -> np.ndarray:
    """What cross_undone() undoes; tiles hold green to red in blue, green to blue in green and red to blue in red."""
    parts, by = split(pixels), split(spread(tiles, step, *pixels.shape))
    blue, green, red = (parts[..., i] for i in range(3))
    new = (blue - cross_delta(by[..., 1], green) - cross_delta(by[..., 2], red)).astype(np.uint8)
    return joined(np.stack([new, green, (red - cross_delta(by[..., 0], green)).astype(np.uint8), parts[..., 3]], -1))


def indexed(pixels: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, int]:
    """Packed indices into a sorted palette, as pixels, and the bits of the packing."""
    index = np.searchsorted(table, pixels).astype(np.int64)
    pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    if pack:
        per, size = 1 << pack, 8 >> pack
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(len(index), -1, per)
        index = (index << np.arange(per) * size).sum(-1)
    return (index << 8 | BLACK).astype(np.uint32), pack


def entropy(pixels: np.ndarray, shifts: tuple[int, ...] = (0, 8, 16, 24)) -> float:
    """Bits by which ideal codes for each channel would tell the pixels."""
    total = 0.0
    for s in shifts:
        c = np.bincount((pixels >> s & 0xFF).ravel(), minlength=256)
        c = c[c > 0]
        total += float((c * np.log2(c.sum() / c)).sum())
    return total


def encode(pixels: np.ndarray, transforms: tuple = (), cache: int = 0, matches: Matches = ()) -> bytes:
    """A lossless WebP file. transforms, in this order: ("predictor", modes, step), ("cross", tiles, step), ("green",), ("palette", sorted colours).

    matches: (place, length, distance) in the pixels as transformed last.
    """
    pixels = np.ascontiguousarray(pixels, np.uint32)
    height, width = pixels.shape
    if not (1 <= height <= 1 << 14 and 1 <= width <= 1 << 14):
        raise ValueError("a side has 1 to 16384 pixels")
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(bool((pixels >> 24 != 255).any())), 1)
    out.put(0, 3)
    for kind, *args in transforms:
        out.put(1, 1)
        if kind == "predictor":
            modes, step = args
            out.put(PREDICTOR, 2)
            out.put(step - 2, 3)
            write_pixels(out, (modes << 8 | BLACK).astype(np.uint32), modes.shape[1])
            pixels = predicted(pixels, modes, step)
        elif kind == "cross":
            tiles, step = args
            out.put(CROSS_COLOUR, 2)
            out.put(step - 2, 3)
            write_pixels(out, tiles.astype(np.uint32), tiles.shape[1])
            pixels = crossed(pixels, tiles, step)
        elif kind == "green":
            out.put(SUBTRACT_GREEN, 2)
            green = pixels >> 8 & 0xFF
            pixels = pixels & 0xFF00FF00 | (pixels & 0x00FF00FF | 0x01000100) - (green << 16 | green) & 0x00FF00FF
        else:
            table = args[0].astype(np.uint32)
            out.put(PALETTE, 2)
            out.put(len(table) - 1, 8)
            write_pixels(out, minus(table, np.concatenate([[0], table[:-1]]).astype(np.uint32)), len(table))
            pixels, _ = indexed(pixels, table)
    out.put(0, 1)
    write_pixels(out, pixels, pixels.shape[1], cache, matches, main=True)
    body = out.bytes()
    pad = len(body) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad
