"""CBOR (RFC 8949): a deterministic encoder, and a decoder that reports in which form the bytes are.

The decoder reads each item once and notes the first breach of the strict form (definite lengths, shortest
arguments) and of the deterministic one (sorted keys, shortest floats, minimal bignums) as it goes, so
the caller can decide afterwards which of them matters. Equal map keys are an error in any form. Nesting
is kept on a stack of its own, so depth can't exhaust Python's.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from typing import Any

MAX_DEPTH = 1000


class Malformed(ValueError):
    """Bytes that aren't one well-formed CBOR item."""


@dataclass(frozen=True)
class Tag:
    """A tagged value."""

    number: int
    value: Any


@dataclass(frozen=True)
class Simple:
    """A simple value without a meaning of its own."""

    number: int


UNDEFINED = Simple(23)


@dataclass
class Form:
    """The first breach of either form, if any."""

    strict: str | None = None
    deterministic: str | None = None

    def lax(self, why: str) -> None:
        self.strict = self.strict or why

    def unsorted(self, why: str) -> None:
        self.deterministic = self.deterministic or why


# --- encoding


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * width:
            return bytes([major << 5 | code]) + n.to_bytes(width, "big")
    raise ValueError("a number needs more than 64 bits")


def encode_float(x: float) -> bytes:
    """The shortest exact width; one spelling of NaN."""
    if math.isnan(x):
        return b"\xf9\x7e\x00"
    for lead, code in ((b"\xf9", ">e"), (b"\xfa", ">f")):
        try:
            packed = struct.pack(code, x)
        except OverflowError:
            continue
        if struct.unpack(code, packed)[0] == x:
            return lead + packed
    return b"\xfb" + struct.pack(">d", x)


def encode(x: Any) -> bytes:
    """The deterministic form of a value."""
    out: list[bytes] = []
    put(x, out.append, 0)
    return b"".join(out)


def put(x: Any, emit, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ValueError("nested too deep")
    if x is None or x is True or x is False:
        emit(b"\xf6" if x is None else b"\xf5" if x else b"\xf4")
    elif isinstance(x, int):
        n = x if x >= 0 else -1 - x
        if n < 1 << 64:
            emit(head(0 if x >= 0 else 1, n))
        else:
            raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
            emit(head(6, 2 if x >= 0 else 3) + head(2, len(raw)) + raw)
    elif isinstance(x, float):
        emit(encode_float(x))
    elif isinstance(x, str):
        raw = x.encode()
        emit(head(3, len(raw)) + raw)
    elif isinstance(x, (bytes, bytearray, memoryview)):
        emit(head(2, len(x)) + bytes(x))
    elif isinstance(x, (list, tuple)):
        emit(head(4, len(x)))
        for y in x:
            put(y, emit, depth + 1)
    elif isinstance(x, dict):
        emit(head(5, len(x)))
        for k, v in sorted((encode(k), v) for k, v in x.items()) if len({encode(k) for k in x}) == len(x) else ():
            emit(k)
            put(v, emit, depth + 1)
    elif isinstance(x, Tag):
        emit(head(6, x.number))
        put(x.value, emit, depth + 1)
    elif isinstance(x, Simple):
        emit(head(7, x.number))
    else:
        raise TypeError(f"no CBOR for {type(x).__name__}")


# --- decoding


@dataclass
class Open:
    """A container that isn't complete: items still to come (None: until a break), and what has come."""

    kind: str  # "list", "map" or "tag"
    left: int | None
    items: list = field(default_factory=list)
    number: int = 0
    begin: int = 0
    keys: set = field(default_factory=set)
    last_key: bytes | None = None


def frozen(x: Any) -> Any:
    """A hashable stand-in for a map key that is a list or a map."""
    if isinstance(x, list):
        return tuple(map(frozen, x))
    if isinstance(x, dict):
        return tuple((frozen(k), frozen(v)) for k, v in x.items())
    return x


def decode(data: bytes) -> tuple[Any, Form]:
    """The one item that data is, and its form."""
    form, stack, at, size = Form(), [], 0, len(data)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > size:
            raise Malformed("ends early")
        at += n
        return data[at - n : at]

    def argument(low: int, major: int) -> int | None:
        """The number after a head; None for an indefinite length."""
        if low < 24:
            return low
        if low == 31:
            form.lax("an indefinite length")
            return None
        if low > 27:
            raise Malformed("reserved head")
        width = 1 << (low - 24)
        n = int.from_bytes(take(width), "big")
        if n < (24 if width == 1 else 1 << 4 * width):
            form.lax("an argument is longer than it need be")
        return n

    while True:
        begin = at
        first = take(1)[0]
        major, low = first >> 5, first & 31
        if first == 0xFF:
            if not stack or stack[-1].left is not None or stack[-1].kind == "tag" or stack[-1].kind == "map" and len(stack[-1].items) % 2:
                raise Malformed("a break out of place")
            stack[-1].left, done, value = 0, True, None
        elif major == 7:
            done = True
            if low in (25, 26, 27):
                raw = take(1 << (low - 24))
                value = struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], raw)[0]
                if first.to_bytes() + raw != encode_float(value):
                    form.unsorted("a float isn't in its shortest form")
            elif low == 24:
                n = take(1)[0]
                if n < 32:
                    form.lax("a simple value is longer than it need be")
                value = Simple(n)
            elif low < 24:
                value = {20: False, 21: True, 22: None}.get(low, Simple(low))
            else:
                raise Malformed("reserved head")
        else:
            n = argument(low, major)
            done = major < 4
            if n is None and major in (0, 1, 6):
                raise Malformed("no such indefinite length")
            if major < 2:
                value = n if major == 0 else -1 - n
            elif major < 4:
                value = take(n) if n is not None else pieces(take, argument, major)
                if major == 3:
                    try:
                        value = value.decode()
                    except UnicodeDecodeError as e:
                        raise Malformed("text isn't UTF-8") from e
            else:
                kind = {4: "list", 5: "map", 6: "tag"}[major]
                stack.append(Open(kind, 1 if major == 6 else None if n is None else n * (major - 3), [], n or 0, begin))
                if len(stack) > MAX_DEPTH:
                    raise Malformed("nested too deep")
                if stack[-1].left == 0:
                    done, value = True, None
        if not done:
            continue
        closing = stack and stack[-1].left == 0 and (first == 0xFF or major in (4, 5))
        while True:
            if closing:
                begin, value = stack[-1].begin, closed(stack.pop(), form)
            if not stack:
                if at != size:
                    raise Malformed("bytes follow the item")
                return value, form
            box = stack[-1]
            box.items.append(value)
            if box.kind == "map" and len(box.items) % 2:
                key(box, value, data[begin:at], form)
            elif box.kind == "tag" and box.number in (2, 3) and isinstance(value, bytes) and (len(value) < 9 or value[0] == 0):
                form.unsorted("a bignum is longer than it need be")
            if box.left is None:
                break
            box.left -= 1
            if box.left:
                break
            closing = True


def pieces(take, argument, major: int) -> bytes:
    """The parts of a string of indefinite length."""
    out = []
    while (first := take(1)[0]) != 0xFF:
        if first >> 5 != major or first & 31 == 31:
            raise Malformed("a wrong part of a string")
        out.append(take(argument(first & 31, major)))
    return b"".join(out)


def key(box: Open, value: Any, raw: bytes, form: Form) -> None:
    """Note a map's key: by its deterministic encoding, so that two spellings of one key are the same."""
    try:
        own = encode(value)
    except (TypeError, ValueError):
        own = raw
    if own in box.keys:
        raise Malformed("duplicate map key")
    box.keys.add(own)
    if box.last_key is not None and raw <= box.last_key:
        form.unsorted("map keys out of order")
    box.last_key = raw


def closed(box: Open, form: Form) -> Any:
    if box.kind == "list":
        return box.items
    if box.kind == "map":
        return {frozen(k): v for k, v in zip(box.items[::2], box.items[1::2])}
    value = box.items[0]
    if box.number in (2, 3) and isinstance(value, bytes):
        n = int.from_bytes(value, "big")
        return n if box.number == 2 else -1 - n
    return Tag(box.number, value)
