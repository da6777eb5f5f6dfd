"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into three segments that fit the perfect binary Golay code (23, 12):
every word of 23 bits lies within 3 bits of exactly one codeword. A word's nearby codewords are those
that some word at one bit's distance or less decodes to: one for words within 2 bits of their own
codeword, six for the others. So if two words differ in one bit at most, the codeword of either is
among the nearby ones of the other.

Pigeonhole: if two fingerprints differ in 3 bits at most, then either
  (A) a segment is equal and another differs in one bit at most; or
  (B) all three differ in exactly one bit, so one half of the third is equal and the first two differ in one bit each.
Every fingerprint is filed once under each of its exact keys, eight in all, and looked up under all
its nearby keys, about ninety. All candidates are verified by counting bits, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import batch, cut, ids_of, keyed, map_batches, text_bytes
from provspark.llm.components import components

#: Bits that may differ, and words in a shingle.
RADIUS, SHINGLE, SEED = 3, 3, 42
#: Segments as (lowest bit, bits); the third one's halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = ((43, 11), (54, 10))
#: Fixed value: the generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
POLYNOMIAL = 0b101011100011
#: Fingerprints under one key that one task compares with others; a key that has more is split into a grid.
BLOCK = 4096
#: Frequent fingerprints that are broadcast with their components: so many at most, as each has more than that share of all rows.
MOST_HOT = 10_000
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("side", pa.int8()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text's UTF-8 as an unsigned number. No words: 0; fewer than a shingle: one shingle of all."""
    words = text.lower().split()  # of bytes: A-Z, and exactly the six ASCII separators
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        some = words[at : min(n, at + (1 << 16)) + shingle - 1]
        runs = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if n > 1 or len(words) >= shingle else [b" ".join(some)]
        h = np.fromiter((digest(x, SEED) for x in runs), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id; fp, the fingerprint as a signed 64-bit number; and digest, the text's own 64-bit hash."""

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(x, shingle) for x in text_bytes(rows.column("text"))], np.uint64)
            return batch(FINGERPRINTS, doc_id=ids_of(rows), fp=pa.array(found.view(np.int64)), digest=rows.column("digest"))

        return f

    return map_batches(keyed(docs).withColumn("digest", F.xxhash64("text")), ["doc_id", "text", "digest"], make, "doc_id long, fp long, digest long")


def codewords() -> np.ndarray:
    """The 4096 words of 23 bits of the code, by their 12 message bits."""
    messages = np.arange(1 << 12, dtype=np.uint32)
    rest = messages << 11
    for bit in range(22, 10, -1):  # division by the polynomial leaves the check bits
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(POLYNOMIAL << bit - 11), rest)
    return messages << 11 | rest


class Golay:
    """Decoding tables: index[w] is the codeword nearest to word w, by its 12 message bits; far[w] tells whether it is 3 bits away."""

    def __init__(self) -> None:
        messages, words = np.arange(1 << 12, dtype=np.uint32), codewords()
        self.index, self.far = np.empty(1 << 23, np.uint16), np.zeros(1 << 23, bool)
        bits = [1 << i for i in range(23)]
        errors = [[0], bits, [x | y for i, x in enumerate(bits) for y in bits[:i]], [x | y | z for i, x in enumerate(bits) for j, y in enumerate(bits[:i]) for z in bits[:j]]]
        for weight, group in enumerate(errors):
            for e in group:
                self.index[words ^ np.uint32(e)] = messages
                if weight == 3:
                    self.far[words ^ np.uint32(e)] = True

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of words and the indices of their nearby codewords, each once."""
        rows = np.nonzero(self.far[words])[0]
        around = np.sort(self.index[words[rows][:, None] ^ np.concatenate([[0], 1 << np.arange(23)]).astype(words.dtype)], axis=1)
        first = np.ones(around.shape, bool)
        first[:, 1:] = around[:, 1:] != around[:, :-1]
        near = np.nonzero(~self.far[words])[0]
        return np.concatenate([near, rows[np.nonzero(first)[0]]]), np.concatenate([self.index[words[near]], around[first]]).astype(np.int64)


def part(fp: np.ndarray, low: int, width: int) -> np.ndarray:
    return (fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row number, all pairs of its values in a and in b: row, value of a, value of b."""
    order = np.argsort(b[0], kind="stable")
    count = np.bincount(b[0], minlength=rows)
    begin = np.cumsum(count) - count
    times = count[a[0]]
    row, left = np.repeat(a[0], times), np.repeat(a[1], times)
    step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, left, b[1][order][begin[row] + step]


def keys_of(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides (0: filed, 1: looked up) and row numbers. A key that the row is filed under isn't looked up by it again."""
    words = [part(fp, *s) for s in SEGMENTS]
    own = [code.index[w].astype(np.int64) for w in words]
    near = [code.nearby(w) for w in words]
    every, out = np.arange(len(fp)), []
    kinds = [(i, j) for i in range(3) for j in range(3) if i != j]
    for kind, (same, close) in enumerate(kinds):
        head = np.int64(kind) << 40
        out.append((head | words[same] << 12 | own[close], 0, every))
        row, index = near[close]
        out.append((head | words[same][row] << 12 | index, 1, row))
    pairs = product(near[0], near[1], len(fp))
    for kind, half in enumerate(HALVES, len(kinds)):
        head, equal = np.int64(kind) << 40, part(fp, *half)
        out.append((head | equal << 24 | own[0] << 12 | own[1], 0, every))
        out.append((head | equal[pairs[0]] << 24 | pairs[1] << 12 | pairs[2], 1, pairs[0]))
    return np.concatenate([k for k, _, _ in out]), np.concatenate([np.full(len(k), s, np.int8) for k, s, _ in out]), np.concatenate([r for _, _, r in out])


def filed(distinct: DataFrame) -> DataFrame:
    """key, side and fp for a table of distinct fingerprints."""

    def make():
        code = Golay()

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            signed = rows.column("fp").to_numpy(zero_copy_only=False)
            key, side, row = keys_of(signed.view(np.uint64), code)
            return batch(KEYS, key=pa.array(key), side=pa.array(side), fp=pa.array(signed[row]))

        return f

    return map_batches(distinct, ["fp"], make, "key long, side byte, fp long")


def gridded(keys: DataFrame, block: int) -> DataFrame:
    """cell, key, side and fp: a key under which more than block fingerprints are filed becomes a grid of cells.

    Filed rows take one row of the grid and looked-up rows one column, so each pair still meets in exactly
    one cell, and no task holds more than about block filed fingerprints.
    """
    hot = keys.filter("side = 0").groupBy("key").count().filter(F.col("count") > block).select(F.col("key").alias("k"), F.ceil(F.col("count") / block).cast("int").alias("n"))
    wide = keys.join(hot, F.col("key") == F.col("k"), "left").withColumn("own", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("n"))))
    line = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.when(F.col("side") == 0, F.col("own") * F.col("n") + x).otherwise(x * F.col("n") + F.col("own")))
    return wide.select(F.explode(F.coalesce(F.when(F.col("n").isNotNull(), line), F.array(F.lit(0).cast("bigint")))).alias("cell"), "key", "side", "fp")


class Meeting:
    """Links between the fingerprints filed under one key and those looked up there, without redundant ones.

    Holds the filed ones only (block at most, see gridded()); looked-up ones pass by. A looked-up one is
    linked with one neighbour of each group that isn't connected yet, so links number fewer than the rows.
    """

    def __init__(self) -> None:
        self.key, self.filed, self.up = None, np.empty(0, np.uint64), np.empty(0, np.int64)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def pass_by(self, fp: np.ndarray) -> Iterator[tuple[int, int]]:
        step = max(1, (1 << 22) // max(1, len(self.filed)))
        for at in range(0, len(fp), step):
            some = fp[at : at + step]
            apart = np.bitwise_count(some[:, None] ^ self.filed[None, :])
            row, col = np.nonzero((apart <= RADIUS) & (apart > 0))
            if not len(row):
                continue
            # The first neighbour always; others only where they join groups that were apart.
            first = np.concatenate([[True], row[1:] != row[:-1]])
            base = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            for i in np.nonzero(first | (self.up[col] != self.up[col[base]]))[0]:
                if first[i]:
                    yield int(some[row[i]]), int(self.filed[col[i]])
                else:
                    x, y = self.root(col[i]), self.root(col[base[i]])
                    if x != y:
                        self.up[max(x, y)] = min(x, y)
                        yield int(some[row[i]]), int(self.filed[col[i]])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, key, side, fp), sorted, to links; a group may go on through many batches."""
    now, tail = Meeting(), None
    for rows in batches:
        key = np.stack([rows.column("key").to_numpy(), rows.column("cell").to_numpy()])
        side, fp = rows.column("side").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        edge = np.concatenate([[0], np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1, [len(fp)]])
        size, out = np.diff(edge), []
        # Groups within this batch that have two rows: most of those that have a pair at all.
        first = edge[:-1]
        goes_on = tail is not None and len(fp) and (key[:, 0] == tail).all()
        inner = np.ones(len(size), bool)
        inner[-1:] = False
        inner[:1] &= not goes_on
        two = first[inner & (size == 2)]
        two = two[side[two] != side[two + 1]]
        apart = np.bitwise_count(fp[two] ^ fp[two + 1])
        two = two[(apart <= RADIUS) & (apart > 0)]
        pairs = [np.stack([fp[two], fp[two + 1]])]
        for g in np.nonzero(~inner | (size > 2))[0]:
            a, b = edge[g], edge[g + 1]
            if g or not goes_on:
                now = Meeting()
            mid = a + int(np.searchsorted(side[a:b], 1))
            if mid > a:
                now.filed = np.concatenate([now.filed, fp[a:mid]])
                now.up = np.arange(len(now.filed))
            if mid < b and len(now.filed):
                out += now.pass_by(fp[mid:b])
        tail = key[:, -1] if len(fp) else tail
        if out:
            pairs.append(np.array(out, np.uint64).T)
        pairs = np.concatenate(pairs, axis=1).view(np.int64)
        if pairs.size:
            yield batch(LINKS, a=pa.array(pairs[0]), b=pa.array(pairs[1]))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints that chains of links within RADIUS connect."""
    rows = gridded(filed(distinct), block)
    sorted_rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "side")
    found = sorted_rows.mapInArrow(meet, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, component_id, the smallest doc_id of all documents whose fingerprints are reachable, and n, its rows, for each distinct fp of (doc_id, fp)."""
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(least.select("fp"), block)).withColumnRenamed("node", "fp")
    joined = least.join(roots, "fp")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = joined.join(of_root, "root").select(F.col("fp").alias("moved"), "component_id")
    return least.join(moved, F.col("fp") == F.col("moved"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")


def named(prints: DataFrame, of: DataFrame, block: int = BLOCK) -> DataFrame:
    """prints with the component_id of classes(). Fingerprints of a share of all rows that MOST_HOT or fewer can have are broadcast, the others joined."""
    of = cut(of)
    least = max(block, (of.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = of.filter(F.col("n") > least).select(F.col("fp").alias("hot"), F.col("component_id").alias("known"))
    met = prints.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left")
    rest = met.filter("hot IS NULL").drop("hot", "known").join(of.select("fp", "component_id"), "fp")
    return met.filter("hot IS NOT NULL").withColumn("component_id", F.col("known")).select(rest.columns).unionByName(rest)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, one row for each row of docs.

    A null text is an empty one: fingerprint 0. Repeated rows repeat. A null doc_id gets a row, but
    never names a component unless there is no other; its component_id is then null. Other columns are ignored.
    """
    prints = cut(fingerprints(docs).select("doc_id", "fp"))
    out = named(prints, classes(prints, block), block)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
