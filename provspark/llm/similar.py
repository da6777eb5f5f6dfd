"""SimHash near-duplicates at a Jaccard similarity, by Golay codewords of soft decisions.

Where texts are held to be near-duplicates from a Jaccard similarity of 0.8 of their five-word shingles on, their
fingerprints differ in 15 of 100 bits, too many for a pigeonhole over exact segments. So fingerprints are wider here and
decoded softly. Each shingle's hash is spread to LANES words of 64 bits; a bit's margin is the number of distinct
shingles that set it less the number that don't. The margins of 23 bits are decoded to the Golay codeword that they
correlate with most, which similar texts share far oftener than as many equal bits (at 0.8: one segment in four).

Pigeonhole: two texts meet if they share two of SEGMENTS codewords or more, so a text is filed under the pairs of its
codewords, 153 keys. In theory that finds 97 of 100 pairs at 0.8 exactly, 99 at 0.85 and all but one of 1000 at 0.9. What meets
is compared by 192 bits; links that hold there are thinned to spanning ones, and the true shingle sets verify each.

An exact check follows, for the pairs that this leaves out: those of other codewords or more differing bits (texts of a few
shingles above all), and those whose thinned links failed. In any one order of all shingles, two sets of the similarity share
one of their leading ones (a fifth of each at 0.8), so texts are filed under these, rare ones first. Pairs that meet there,
aren't linked yet and whose sizes, places and sketches allow the similarity are verified too. So components are exactly
those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import batch, cut, ids_of, keyed, map_batches, text_bytes, tidy
from provspark.llm.components import components
from provspark.llm.simhash import SEED, codewords

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint, bits and number of its segments, and words that go along to compare.
LANES, BITS, SEGMENTS, CARRIED = 7, 23, 18, 3
#: Differing bits of the carried ones: beyond the first, no link; up to the second, surely one. Expected at 0.8: 29, with a deviation of 5.
APART, SURE = 41, 24
#: Rows under a key that one task compares with each other; keys that seem to have more are dealt to a grid of tasks.
BLOCK = 4096
#: One text in so many is asked which keys are hot. That decides where rows meet, never whether.
ASKED = 128
#: One text in so many is asked which shingles are frequent, and how often it has to have one. That decides their order, never whether.
COUNTED, OFTEN = 16, 4
#: Rows up to which a list is broadcast, and most frequent shingles.
BROADCAST = 100_000
PRINTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("id", pa.int64()), *((f"w{i}", pa.int64()) for i in range(CARRIED)), ("codes", pa.binary()), ("size", pa.int64()), ("lead", pa.binary()), ("sketch", pa.binary())])
PRINTS_SQL = "doc_id long, digest long, id long, " + ", ".join(f"w{i} long" for i in range(CARRIED)) + ", codes binary, size long, lead binary, sketch binary"
WORDS = [f"w{i}" for i in range(CARRIED)]
#: Far more than a rounding error of the similarity times a set's size, and far less than one shingle.
SLACK = 1e-6
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted: A-Z lower-cased; fewer words than size are one shingle; none: empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, found = xxhash.xxh64_intdigest, []
    for at in range(0, max(1, len(words) - size + 1), 1 << 16):  # bounded memory for very long texts
        some = words[at : at + (1 << 16) + size - 1]
        runs = map(b" ".join, zip(*(some[i:] for i in range(size)))) if len(words) >= size else [b" ".join(some)]
        found.append(np.unique(np.fromiter((digest(x, SEED) for x in runs), np.uint64)))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def spread(h: np.ndarray) -> np.ndarray:
    """LANES words for each hash, mixed by shifts and odd factors so that their bits are independent."""
    x = h[:, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def margins(h: np.ndarray) -> np.ndarray:
    """For each bit: hashes that set it less those that don't."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), 1 << 13):
        bits = np.unpackbits(spread(h[at : at + (1 << 13)]).astype("<u8").view(np.uint8).reshape(-1, 8 * LANES), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return 2 * ones - len(h)


def signs(code: np.ndarray) -> np.ndarray:
    """Codewords as columns of -1 and 1."""
    return (2.0 * (code[None, :] >> np.arange(BITS, dtype=code.dtype)[:, None] & 1) - 1).astype(np.float32)


def decoded(margin: np.ndarray, book: np.ndarray) -> np.ndarray:
    """By row and segment the number of the codeword that margins correlate with most; the first of several."""
    parts = margin[:, : BITS * SEGMENTS].reshape(-1, BITS).astype(np.float32)
    # Any positive factor leaves the order; small whole numbers make sums exact, so equal texts decode alike everywhere.
    return np.concatenate([(parts[at : at + 512] @ book).argmax(1) for at in range(0, len(parts), 512)]).astype("<u2").reshape(-1, SEGMENTS)


def frequent(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the most frequent shingles, BROADCAST at most, rarer ones first: by a sample of the distinct texts."""
    schema = pa.schema([("key", pa.int64())])

    def make():
        return lambda rows: batch(schema, key=pa.array(np.concatenate([shingles(x, shingle) for x in text_bytes(rows.column("text"))]).view(np.int64)))

    some = keyed(docs).filter(F.pmod(F.xxhash64("text", F.lit(2)), F.lit(COUNTED)) == 0).select("text").dropDuplicates()
    often = cut(map_batches(some, ["text"], make, "key long").groupBy("key").count().filter(F.col("count") >= OFTEN))
    room, least = BROADCAST, None
    for r in sorted(often.groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if r.n > room:
            break
        room, least = room - r.n, r[0]
    if least is None:
        return np.empty(0, np.uint64)
    rows = often.filter(F.col("count") >= least).select("count", "key").collect()
    return np.array([k for _, k in sorted(map(tuple, rows))], np.int64).view(np.uint64)


def leading(h: np.ndarray, often: np.ndarray, by: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's hashes, rare ones by value and then frequent() ones: sets of the similarity have one of them in common.

    They share similarity times the larger one's size or more, too many to lie behind the leading ones. by sorts often.
    """
    n = len(h) - math.ceil(similarity * len(h) - SLACK) + 1
    at = by[np.minimum(np.searchsorted(often, h, sorter=by), len(often) - 1)] if len(often) else np.zeros(len(h), np.int64)
    known = often[at] == h if len(often) else np.zeros(len(h), bool)
    rare = h[~known][:n]
    return np.concatenate([rare, often[np.sort(at[known])][: n - len(rare)]])


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes by their lowest bits, about as many as hashes, packed: every bit that differs is a hash that isn't shared."""
    bits = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the other's length."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def prints(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id; digest, the text's own hash; id, the shingle set's hash; the fingerprint's carried words and codewords; the set's size, leading hashes and sketch."""
    often = frequent(docs, shingle)

    def make():
        book, by = signs(codewords()), np.argsort(often)

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, shingle).astype("<u8") for x in text_bytes(rows.column("text"))]
            margin = np.array([margins(h) for h in sets])
            words = np.packbits(margin > 0, axis=1, bitorder="little").view("<u8").view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            of_set = dict(size=[len(h) for h in sets], lead=[leading(h, often, by, similarity).astype("<u8").tobytes() for h in sets], sketch=[sketch(h).tobytes() for h in sets])
            return batch(PRINTS, doc_id=ids_of(rows), digest=rows.column("digest"), id=pa.array(ids), codes=[x.tobytes() for x in decoded(margin, book)], **of_set, **{n: pa.array(words[:, i]) for i, n in enumerate(WORDS)})

        return f

    return map_batches(keyed(docs).withColumn("digest", F.xxhash64("text")), ["doc_id", "text", "digest"], make, PRINTS_SQL)


def filed(distinct: DataFrame) -> DataFrame:
    """key, id and carried words: a row for each pair of a fingerprint's codewords."""
    i, j = np.triu_indices(SEGMENTS, 1)
    head = np.arange(len(i), dtype=np.int64) << 24
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), *((n, pa.int64()) for n in WORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = whole.slice(at, 256)
                code = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<u2").reshape(-1, SEGMENTS).astype(np.int64)
                key = head | code[:, i] << 12 | code[:, j]
                again = {n: pa.array(np.repeat(rows.column(n).to_numpy(), len(i))) for n in ("id", *WORDS)}
                yield batch(schema, key=pa.array(key.ravel()), **again)

    return distinct.select("id", *WORDS, "codes").mapInArrow(tidy(run), "key long, id long, " + ", ".join(f"{n} long" for n in WORDS))


def dealt(keys: DataFrame, asked: DataFrame, block: int, carried: list[str] = WORDS) -> DataFrame:
    """key, id and carried columns with cell and side: rows of a hot key are dealt to blocks, and every two blocks meet in one cell, as does each with itself.

    side is 0 for rows that are compared with those of side 1, and 2 for rows that are compared with each other.
    """
    hot = cut(asked.groupBy("key").count().filter(F.col("count") * ASKED > block).select(F.col("key").alias("k"), F.ceil(F.col("count") * ASKED / block).cast("int").alias("n")))
    if not (size := hot.count()):
        return keys.withColumns({"cell": F.lit(0).cast("bigint"), "side": F.lit(2).cast("byte")})
    wide = keys.join(F.broadcast(hot) if size <= BROADCAST else hot, F.col("key") == F.col("k"), "left")
    own, n = F.col("own"), F.col("n").cast("bigint")
    wide = wide.withColumn("own", F.pmod(F.xxhash64("id"), n))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda x: F.struct((F.least(own, x) * n + F.greatest(own, x)).alias("cell"), F.when(own == x, 2).when(own < x, 0).otherwise(1).cast("byte").alias("side")))
    plain = F.array(F.struct(F.lit(0).cast("bigint").alias("cell"), F.lit(2).cast("byte").alias("side")))
    return wide.select("key", "id", *carried, F.explode(F.coalesce(F.when(n.isNotNull(), cells), plain)).alias("at")).select("key", "id", *carried, "at.cell", "at.side")


class Forest:
    """Links between rows of one group that connect whatever is APART bits from each other or less, fewer than the rows."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, apart: int) -> None:
        order = np.argsort(ids)  # so that every key's group links to the same ones where it can
        self.ids, self.words, self.apart, self.up = ids[order], words[order], apart, np.arange(len(ids))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def links(self, ids: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of further rows, or of the same: of each to its best row here, and to others that aren't connected with that one yet."""
        step = max(1, (1 << 21) // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            apart = np.zeros((len(ids[at : at + step]), len(self.ids)), np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[at : at + step, k, None] ^ self.words[None, :, k])
            near = (apart <= self.apart) & (ids[at : at + step, None] != self.ids[None, :])
            some = np.nonzero(near.any(1))[0]
            if not len(some):
                continue
            best = np.where(near[some], np.maximum(apart[some], SURE), 1 << 15).argmin(1)
            for i, b in zip(some, best):
                yield int(ids[at + i]), int(self.ids[b])
            # Rows whose neighbours hang together already need no more.
            flat = np.array([self.root(x) for x in range(len(self.up))]) if len(self.up) < 1 << 16 else self.up
            self.up = flat
            row, col = np.nonzero(near[some] & (flat[None, :] != flat[best][:, None]))
            for r, c in zip(row, col):
                x, y = self.root(c), self.root(best[r])
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    yield int(ids[at + some[r]]), int(self.ids[c])


def met(rows: DataFrame, carried: list[str], told: Callable, fit: Callable) -> DataFrame:
    """Links that told() and fit() find among the rows of dealt() that share key and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(batches, carried, told, fit)

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "side", "id", *carried).mapInArrow(tidy(run), "a long, b long").distinct()


def grouped(batches: Iterator[pa.RecordBatch], carried: list[str], told: Callable, fit: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of dealt(), sorted by key and cell, to links; a group may go on through several batches.

    told() gives arrays of links (one a row) among a group's rows, of which the columns are key, cell, side, id and what is
    carried; fit() tells which rows of two such tables link.
    """
    held: list[np.ndarray] = []

    def packed(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x in found:
            if len(x):
                yield batch(LINKS, a=pa.array(x.min(1)), b=pa.array(x.max(1)))

    for rows in batches:
        if not rows.num_rows:
            continue
        now = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in ("key", "cell", "side", "id", *carried)], axis=1)
        edge = np.concatenate([[0], np.nonzero((now[1:, :2] != now[:-1, :2]).any(1))[0] + 1, [len(now)]])
        if held and (held[0][0, :2] != now[0, :2]).any():
            yield from packed(told(np.concatenate(held)))
            held = []
        first = 0
        if held:
            held.append(now[: edge[1]])
            first = 1
            if len(edge) > 2:
                yield from packed(told(np.concatenate(held)))
                held = []
        if held:
            continue
        # Whole groups inside this batch; pairs of rows, by far the most of them, at once.
        size = np.diff(edge)[first:-1]
        two = edge[first:-2][size == 2] if len(edge) > 2 else np.empty(0, np.int64)
        if len(two):
            good = two[fit(now[two], now[two + 1]) & (now[two, 3] != now[two + 1, 3])]
            yield from packed([np.stack([now[good, 3], now[good + 1, 3]], axis=1)])
        for g in np.nonzero(size > 2)[0] + first:
            yield from packed(told(now[edge[g] : edge[g + 1]]))
        held = [now[edge[-2] :]]
    if held:
        yield from packed(told(np.concatenate(held)))


def sides(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The rows of a group that are compared with each other, and whether they are the same."""
    side = rows[:, 2]
    for one, other in ((2, 2), (0, 1)):
        a, b = rows[side == one], rows[side == other]
        if len(a) and len(b) and (one != other or len(a) > 1):
            yield a, b, one == other


def spanning(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Thinned links between rows that are APART bits from each other or less."""
    for a, b, _ in sides(rows):
        found = list(Forest(a[:, 3], a[:, 4:].view(np.uint64), APART).links(b[:, 3], b[:, 4:].view(np.uint64)))
        yield np.array(found, np.int64).reshape(-1, 2)


def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x[:, 4:] ^ y[:, 4:]).view(np.uint64)).sum(1, dtype=np.int64) <= APART


def candidates(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between ids that seem similar by their carried bits, thinned."""
    some = filed(distinct.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ASKED)) == 0))
    rows = dealt(filed(distinct), some, block)
    return met(rows, WORDS, spanning, close)


def allowed(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows of led() are of two components and may have the similarity, if none of their earlier leading hashes is shared.

    From a shared hash on, two sets can share no more hashes than either has left. Arrays of rows are broadcast.
    """
    left = np.minimum((x[..., 5] >> 32) - (x[..., 5] & 0xFFFFFFFF), (y[..., 5] >> 32) - (y[..., 5] & 0xFFFFFFFF))
    return (x[..., 4] != y[..., 4]) & ((1 + similarity) * left >= similarity * ((x[..., 5] >> 32) + (y[..., 5] >> 32)) - SLACK)


def every(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """All allowed() pairs among the rows of a group, each once."""
    for a, b, same_rows in sides(rows):
        if (a[:, 4] == a[0, 4]).all() and (b[:, 4] == a[0, 4]).all():
            continue
        step = max(1, (1 << 20) // len(a))
        for at in range(0, len(b), step):
            y = b[at : at + step]
            fits = allowed(y[:, None], a[None, :], similarity)
            if same_rows:
                fits &= y[:, None, 3] < a[None, :, 3]
            i, j = np.nonzero(fits)
            yield np.stack([y[i, 3], a[j, 3]], axis=1)


def led(distinct: DataFrame) -> DataFrame:
    """key, id, root and place (the set's size in the upper half, the hash's number in the lower) for each leading hash of (id, root, size, lead)."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("root", pa.int64()), ("place", pa.int64())])

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            lead = rows.column("lead").to_pylist()
            n = np.array([len(x) // 8 for x in lead], np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            again = {c: np.repeat(rows.column(c).to_numpy(), n) for c in ("id", "root", "size")}
            return batch(schema, key=pa.array(np.frombuffer(b"".join(lead), "<i8")), id=pa.array(again["id"]), root=pa.array(again["root"]), place=pa.array(again["size"] << 32 | at))

        return f

    return map_batches(distinct, ["id", "root", "size", "lead"], make, "key long, id long, root long, place long")


def remaining(distinct: DataFrame, roots: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different roots that may have the similarity; none is left out that has it."""
    of = rooted(distinct.select("id", "size", "lead"), roots)
    some = led(of.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ASKED)) == 0))
    rows = dealt(led(of), some, block, ["root", "place"])
    pairs = met(rows, ["root", "place"], lambda x: every(x, similarity), lambda x, y: allowed(x, y, similarity))
    one = pairs.join(distinct.select(F.col("id").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("x")), "a")
    both = one.join(distinct.select(F.col("id").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("y")), "b")

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            total = rows.column("n").to_numpy() + rows.column("m").to_numpy()
            apart = [differing(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(rows.column("x").to_pylist(), rows.column("y").to_pylist())]
            keep = pa.array((1 + similarity) * np.array(apart) <= (1 - similarity) * total + SLACK)
            return batch(LINKS, a=rows.column("a").filter(keep), b=rows.column("b").filter(keep))

        return f

    return map_batches(both, ["a", "b", "n", "m", "x", "y"], make, "a long, b long")


def beside(few: DataFrame) -> DataFrame:
    """few, broadcast if it has BROADCAST rows or fewer."""
    return F.broadcast(few) if few.count() <= BROADCAST else few


def rooted(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """ids with root, each id's own where roots (id, root) hasn't it."""
    return ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles: sorted 64-bit hashes) have the Jaccard similarity or more."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for x, y in zip(rows.column("x").to_pylist(), rows.column("y").to_pylist()):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(shared >= similarity * (len(p) + len(q) - shared) - 1e-9)
            keep = pa.array(good, pa.bool_())
            return batch(LINKS, a=rows.column("a").filter(keep), b=rows.column("b").filter(keep))

        return f

    return map_batches(both, ["a", "b", "x", "y"], make, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, shingles) for wanted (id, doc_id, digest): the texts of these documents alone."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
    texts = marked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    of = wanted.select("id", *key_of(F.col("doc_id"), F.col("digest"), "o"))
    found = texts.join(of, same("k", "o")).select("id", F.col("row.text").alias("text")).dropDuplicates(["id"])

    def make():
        return lambda rows: batch(schema, id=rows.column("id"), shingles=[shingles(x, shingle).astype("<u8").tobytes() for x in text_bytes(rows.column("text"))])

    return map_batches(found, ["id", "text"], make, "id long, shingles binary")


def key_of(doc_id, digest, name: str) -> list:
    """A row's key as three columns without nulls, so that joins and grouping by it share one shuffle."""
    return [doc_id.isNull().alias(f"{name}_none"), F.coalesce(doc_id, F.lit(0).cast("bigint")).alias(f"{name}_id"), digest.alias(f"{name}_digest")]


def same(a: str, b: str) -> list:
    return [F.col(f"{a}_{x}") == F.col(f"{b}_{x}") for x in ("none", "id", "digest")]


def marked(docs: DataFrame) -> DataFrame:
    """row, all columns of docs as one, whatever their names, and its key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_of(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")), "k"))


def linked(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float, shingle: int, few: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """The pairs that the true shingle sets verify."""
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = distinct.join(nodes, "id").select("id", F.col("f.d").alias("doc_id"), F.col("f.g").alias("digest"))
    return verified(pairs, cut(shingle_sets(docs, few(wanted), shingle)), similarity)


def classes(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """id and root, its component, for each distinct id of found, the prints() of docs."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("digest").alias("g"))).alias("f")
    distinct = cut(found.groupBy("id").agg(first, *(F.first(n).alias(n) for n in (*WORDS, "codes", "size", "lead", "sketch"))))
    links = linked(docs, distinct, cut(candidates(distinct, block)), similarity, shingle)
    roots = beside(components(links).select(F.col("node").alias("id"), "root"))
    # Shuffled rows and checkpoints that nothing refers to any more leave the disk when the driver collects its garbage.
    docs.sparkSession._jvm.System.gc()
    more = linked(docs, distinct, cut(remaining(distinct, roots, similarity, block)), similarity, shingle, lambda x: beside(cut(x)))
    ends = rooted(rooted(more.withColumnRenamed("a", "id"), roots).select(F.col("root").alias("a"), F.col("b").alias("id")), roots).select("a", F.col("root").alias("b"))
    tops = beside(components(ends).select(F.col("node").alias("root"), F.col("root").alias("top")))
    return rooted(distinct.select("id", "f"), roots).join(tops, "root", "left").select("id", "f", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links reach, one row for each row of docs.

    Nulls, empty and repeated texts as in keep_one().
    """
    found = cut(prints(docs, shingle, similarity))
    of = classes(docs, found, similarity, shingle, block)
    least = of.groupBy("root").agg(F.min("f.d").alias("component_id"))
    named = of.join(least, "root").select("id", "component_id")
    return found.select("doc_id", "id").join(named, "id").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """docs, with all their columns and only these, with one row of each component.

    That is the row of the component's smallest doc_id, a null one last; if rows share it, the first by text digest; if
    they are the same in this too, one of them. Null texts are empty ones; all texts without words are one component, as
    are texts with equal shingles. Texts of fewer words than a shingle have one shingle, of all their words. Very
    long texts are hashed in parts. An empty table gives an empty result. Whole texts are shuffled once to be chosen
    from, and those of candidates once more to be verified.
    """
    found = cut(prints(docs, shingle, similarity))
    first = classes(docs, found, similarity, shingle, block).groupBy("root").agg(F.min("f").alias("f"))
    chosen = first.select(*key_of(F.col("f.d"), F.col("f.g"), "c"))
    kept = marked(docs).join(chosen, same("k", "c"), "left_semi").dropDuplicates(["k_none", "k_id", "k_digest"])
    return kept.select("row.*")
