"""Texts as lossless WebP pictures, read back as arrays of samples.

A payload becomes a grey picture of 8-bit samples, 64 to a row (more for long payloads, as a side has 16,384
pixels at most). The writer takes what tells it in the fewest bits: the green channel alone after
taking green out of red and blue; a palette with packed pixels for payloads of 16 different bytes or
fewer; prediction from above where that has the lower entropy; and copies for runs and repeated lines.
Where tools would do the same, a payload's checksum says which is taken, so that a table's pictures exercise the whole
reader: green goes out by subtraction or by the cross-colour transform, short payloads have a colour cache, and
very short ones all fourteen predictors in tiles. The reader is webp.decode() and knows the whole format.

Defined results: a null or empty text is 64 zero bytes; very long texts are pictures of up to PART bytes; a payload beyond PART bytes is stored as several
files, one after another; equal texts give equal values; a null doc_id stays null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm import webp
from provspark.llm.common import batch, ids_of, keyed, map_batches, text_bytes

ROW, SIDE, PART = 64, 1 << 14, 1 << 26
#: Bytes up to which a payload may have a colour cache, and tiles of all predictors.
SHORT, SHORTEST = 1024, 256
#: Checksums, modulo 8, by which another predictor than the top is tried, with how much further back it looks: top right, top left.
ABOVE = {3: (3, -1), 4: (4, 1)}
#: A cross-colour tile that takes green out of red and blue: by 32 parts of 32 each.
OUT_OF_GREEN = np.uint32(0xFF002020)
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % ROW or (0 if text else ROW))


def repeated_lines(data: bytes, least: int = 16) -> webp.Matches:
    """(place, length, distance) of lines that occurred before."""
    out, seen, at = [], {}, 0
    for line in data.split(b"\n"):
        if len(line) >= least:
            if line in seen:
                out.append((at, len(line), at - seen[line]))
            seen[line] = at
        at += len(line) + 1
    return out


def grey(samples: np.ndarray) -> np.ndarray:
    """ARGB of grey samples."""
    s = samples.astype(np.uint32)
    return s * np.uint32(0x010101) | np.uint32(0xFF000000)


def bits_of(samples: np.ndarray) -> float:
    c = np.bincount(samples, minlength=256)
    c = c[c > 0]
    return float((c * np.log2(c.sum() / c)).sum())


def stored(payload: bytes) -> bytes:
    """A payload of a positive multiple of ROW bytes as WebP files, one after another."""
    out = []
    for at in range(0, len(payload), PART):
        part = payload[at : at + PART]
        width = ROW
        while -(-len(part) // width) > SIDE:
            width *= 2
        samples = np.frombuffer(part + b"\0" * (-len(part) % width), np.uint8)
        flat = samples.reshape(-1, width)
        counts = np.bincount(samples, minlength=256)
        kinds = np.nonzero(counts)[0]
        if len(kinds) <= 16:
            pixels = grey(flat)
            packed, _ = webp.indexed(pixels, grey(kinds))
            how = {"transforms": (("palette", grey(kinds)),), "matches": webp.cut_up(webp.runs(packed.ravel()))}
        else:
            turn = zlib.crc32(part) % 8
            plain = ("green",) if turn else ("cross", np.full((-(-len(flat) // 512), -(-width // 512)), OUT_OF_GREEN), 9)
            mode, aside = ABOVE.get(turn, (2, 0))
            back = width + aside
            rest = samples.copy()
            rest[back:] -= samples[:-back]  # near enough, at the sides, to choose by
            if len(part) <= SHORTEST and turn == 1:
                modes = np.arange(-(-len(flat) // 4) * (width // 4)).reshape(-1, width // 4) % 14
                how = {"transforms": (("predictor", modes, 2), plain)}
            elif bits_of(rest) < 0.95 * bits_of(samples):
                step = min(9, max(2, (max(flat.shape) - 1).bit_length()))
                modes = np.full(tuple(-(-n // (1 << step)) for n in flat.shape), mode)
                how = {"transforms": (("predictor", modes, step), plain) if plain[0] == "cross" else (plain, ("predictor", modes, step))}
            else:
                matches = webp.runs(samples, 16) + repeated_lines(part)
                how = {"transforms": (plain,), "matches": webp.cut_up(matches) if matches else (), "cache": 4 if len(part) <= SHORT and turn % 4 == 2 else 0}
        out.append(webp.encode(grey(flat), **how))
    return b"".join(out)


def read_back(media: bytes) -> np.ndarray:
    """The samples of stored files, with those that fill a last row."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append((webp.decode(media[at:end]) >> 8 & 0xFF).astype(np.uint8).ravel())
        at = end
    return np.concatenate(out)


def feature(samples: np.ndarray) -> str:
    """Rows, different samples, the most frequent one and its number, and sums over even and odd columns."""
    counts = np.bincount(samples, minlength=256)
    columns = samples.reshape(-1, ROW).sum(0, dtype=np.int64)
    return f"rows={len(samples) // ROW};kinds={int((counts > 0).sum())};mode={int(counts.argmax())}x{int(counts.max())};even={int(columns[::2].sum())};odd={int(columns[1::2].sum())}"


def pictures(docs: DataFrame) -> DataFrame:
    """doc_id, payload_bytes and media, the stored files."""
    schema = pa.schema([("doc_id", pa.int64()), ("payload_bytes", pa.int64()), ("media", pa.binary())])

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            payloads = [payload_of(x) for x in text_bytes(rows.column("text"))]
            return batch(schema, doc_id=ids_of(rows), payload_bytes=[len(x) for x in payloads], media=[stored(x) for x in payloads])

        return f

    return map_batches(keyed(docs), ["doc_id", "text"], make, "doc_id long, payload_bytes long, media binary")


def pixel_arrays(media: DataFrame, column: str = "media") -> DataFrame:
    """Any column of lossless WebP files to width, height and argb, four bytes a pixel; files that can't be read have an error instead."""
    schema = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary()), ("error", pa.string())])

    def read(data: bytes | None) -> tuple:
        try:
            pixels = webp.decode(data or b"")
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, str(e) or type(e).__name__
        return pixels.shape[1], pixels.shape[0], pixels.astype("<u4").tobytes(), None

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            got = list(zip(*map(read, rows.column(0).to_pylist())))
            return batch(schema, **dict(zip(schema.names, map(list, got))))

        return f

    return map_batches(media.select(F.col(column).cast("binary").alias("media")), ["media"], make, "width int, height int, argb binary, error string")


def features(docs: DataFrame) -> DataFrame:
    """What each text's picture, written and read back, tells: see FEATURES."""

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {n: [] for n in FEATURES.names[1:]}
            for text in text_bytes(rows.column("text")):
                payload = payload_of(text)
                media = stored(payload)
                samples = read_back(media)[: len(payload)]
                back = samples.tobytes()
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                for n, x in zip(FEATURES.names[1:], row):
                    out[n].append(x)
            return batch(FEATURES, doc_id=ids_of(rows), **out)

        return f

    return map_batches(keyed(docs), ["doc_id", "text"], make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
