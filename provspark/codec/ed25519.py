"""Ed25519 (RFC 8032) in plain Python, with the refusal of small-order keys.

The cryptography package is used for checking if it is there. Otherwise a point is in extended
coordinates, and the base point's multiples come from a table.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from functools import lru_cache

try:
    from cryptography.exceptions import InvalidSignature
    from cryptography.hazmat.primitives.asymmetric.ed25519 import Ed25519PublicKey
except ImportError:
    Ed25519PublicKey = None

#: Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
ZERO = (0, 1, 1, 0)

Point = tuple[int, int, int, int]


def plus(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def twice(p: Point) -> Point:
    a, b = p[0] * p[0] % P, p[1] * p[1] % P
    e, g, h = (p[0] + p[1]) ** 2 - a - b, b - a, -a - b
    f = g - 2 * p[2] * p[2]
    return e * f % P, g * h % P, f * g % P, e * h % P


def times(n: int, p: Point) -> Point:
    """Four bits of n at a time."""
    row = [ZERO, p]
    for _ in range(14):
        row.append(plus(row[-1], p))
    out = ZERO
    for digit in f"{n:x}":
        out = plus(twice(twice(twice(twice(out)))), row[int(digit, 16)])
    return out


def same(p: Point, q: Point) -> bool:
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def from_bytes(raw: bytes) -> Point | None:
    """A point from 32 bytes; None if there is none, or y isn't below the field's order."""
    n = int.from_bytes(raw, "little")
    y, odd = n & (1 << 255) - 1, n >> 255
    if len(raw) != 32 or y >= P:
        return None
    xx = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(xx, (P + 3) // 8, P)
    if (x * x - xx) % P:
        x = x * ROOT % P
    if (x * x - xx) % P or x == 0 and odd:
        return None
    x = P - x if x & 1 != odd else x
    return x, y, 1, x * y % P


def to_bytes(p: Point) -> bytes:
    z = pow(p[2], P - 2, P)
    return (p[1] * z % P | (p[0] * z % P & 1) << 255).to_bytes(32, "little")


BASE = from_bytes((4 * pow(5, P - 2, P) % P).to_bytes(32, "little"))


def table_of(p: Point) -> list[list[Point]]:
    """Multiples 0 to 15 of a point, by each power of 16."""
    out = []
    for _ in range(64):
        row = [ZERO]
        for _ in range(15):
            row.append(plus(row[-1], p))
        out.append(row)
        p = plus(row[-1], p)
    return out


@lru_cache(1)
def base_table() -> list[list[Point]]:
    return table_of(BASE)


def summed(n: int, table: list[list[Point]]) -> Point:
    """n times the point of a table."""
    out = ZERO
    for row in table:
        out, n = plus(out, row[n & 15]), n >> 4
    return out


def base_times(n: int) -> Point:
    return summed(n, base_table())


class Frequent:
    """The negative of a public key, with a table once it has been used a few times. A table is some 300 KB."""

    def __init__(self, key: bytes) -> None:
        x, y, _, t = from_bytes(key)
        self.point, self.uses, self.table = (-x % P, y, 1, -t % P), 0, None

    def times(self, n: int) -> Point:
        self.uses += 1
        if self.uses > 4 and self.table is None:
            self.table = table_of(self.point)
        return times(n, self.point) if self.table is None else summed(n, self.table)


#: Keys of signers, the latest used ones.
frequent = lru_cache(100)(Frequent)


def hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def expanded(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


@lru_cache(4096)
def public_key(seed: bytes) -> bytes:
    return to_bytes(base_times(expanded(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = expanded(seed)
    key = public_key(seed)
    r = hashed(prefix, message) % ORDER
    point = to_bytes(base_times(r))
    return point + ((r + hashed(point, key, message) * a) % ORDER).to_bytes(32, "little")


@lru_cache(4096)
def weak(key: bytes) -> bool:
    """Whether a 32-byte key is no point, or one of small order, which nobody can own."""
    p = from_bytes(key)
    return p is None or same(times(8, p), ZERO)


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is good; never under a weak key."""
    if len(key) != 32 or len(signature) != 64 or weak(key):
        return False
    if Ed25519PublicKey is not None:
        try:
            Ed25519PublicKey.from_public_bytes(key).verify(signature, message)
        except InvalidSignature:
            return False
        return True
    s, r = int.from_bytes(signature[32:], "little"), signature[:32]
    if s >= ORDER:
        return False
    return to_bytes(plus(base_times(s), frequent(key).times(hashed(r, key, message) % ORDER))) == r


def seed_from_words(words: str, passphrase: str = "", rounds: int = 600_000) -> bytes:
    """A private seed from a mnemonic, by PBKDF2 with SHA-512."""
    return hashlib.pbkdf2_hmac("sha512", " ".join(words.split()).encode(), b"mnemonic" + passphrase.encode(), rounds)[:32]


def raw_key(text: str) -> bytes | None:
    """32 bytes from base64, or None."""
    try:
        raw = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw if len(raw) == 32 else None
