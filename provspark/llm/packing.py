"""Best-fit decreasing packing of token sequences.

Best fit depends on lengths alone, and lengths are whole numbers up to the capacity. So the plan is
made from the number of pieces of each length, capacity numbers whatever the corpus: longest first, a segment
tree over remaining capacities finds the tightest open bins, and all pieces of one length that go
to bins of one remainder are placed at once, as runs. The result is that of placing piece after piece. A
piece then finds its bin from its length and its rank among the pieces of that length, which comes from
counts by hash bucket, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import batch, cut, ids_of, keyed, map_batches, text_bytes
from provspark.llm.tokens import id_lists, shared_words

CAPACITY, END = 2048, 0
#: Pieces for which there is one more hash bucket.
BUCKET = 20_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """Each document's ids and a last id 0, cut into pieces only where they are more than capacity."""

    def make():
        words = shared_words(tokenizer)

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {n: [] for n in PIECES.names}
            for doc, found in zip(ids_of(rows).to_pylist(), id_lists(text_bytes(rows.column("text")), words)):
                ids = memoryview(found + END.to_bytes(4, "little"))
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for n, x in zip(PIECES.names, (doc, k, at, len(part) // 4, zlib.crc32(part))):
                        out[n].append(x)
            return batch(PIECES, **out)

        return f

    return map_batches(keyed(docs), ["doc_id", "text"], make, COLUMNS, remembers=True)


class Tightest:
    """A segment tree over remainders 0 to capacity: which of them have open bins, and the smallest such one from a given on."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, remainder: int, there: bool) -> None:
        i = self.width + remainder
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def find(self, least: int) -> int:
        """The smallest remainder of an open bin that is at least least, or -1."""
        i = self.width + least
        while not self.any[i]:
            while i & 1:  # the last right child was empty: go up
                i >>= 1
            if i == 0:
                return -1
            i += 1
            if i & i - 1 == 0:  # past the right edge of its level
                return -1
        while i < self.width:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.width


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length, runs of pieces as rows (first rank, first bin, pieces in each bin one after another, offset in the bin).

    Open bins of one remainder are kept as runs of bin numbers (first, number). A run's bins all take as
    many pieces of a length as they hold before the next bin is touched, as single placement would do.
    """
    tree, open_bins, made, out = Tightest(capacity), {}, 0, {}

    def put(remainder: int, first: int, n: int) -> None:
        if n and remainder:
            if not open_bins.setdefault(remainder, []):
                tree.set(remainder, True)
            open_bins[remainder].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            r = tree.find(length)
            if r < 0:
                per = capacity // length
                r, first, n = capacity, made, -(-left // per)
                made += n
            else:
                first, n = open_bins[r].pop()
                if not open_bins[r]:
                    tree.set(r, False)
            per = r // length
            runs.append((rank, first, per, capacity - r))
            full, rest = divmod(min(left, per * n), per)
            put(r - per * length, first, full)
            if rest:
                put(r - rest * length, first + full, 1)
            put(r, first + full + bool(rest), n - full - bool(rest))
            rank += full * per + rest
            left -= full * per + rest
        out[length] = np.array(runs, np.int64)
    return out


def ranked(cut_up: DataFrame, n: int) -> DataFrame:
    """Pieces with rank, from 0, among those of their length: counts by bucket give each bucket's first rank.

    cut_up is a checkpoint, so a row's number there, which tells repeated rows apart and spreads them, is the same whenever it is read.
    """
    keys = ["length", "bucket"]
    rows = cut_up.withColumn("rid", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "rid"), F.lit(max(8, n // BUCKET))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys).count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("length").alias("l"), F.col("bucket").alias("b"), "base")
    own = Window.partitionBy(*keys).orderBy("doc_id", "piece", "start", "ids_crc32", "rid")
    numbered = rows.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(base, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("base") + F.col("own"))


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row for each piece.

    A null or empty text is the id 0 alone. Repeated rows are packed each. A null doc_id stays null; an
    empty table gives an empty result; other columns are ignored. Very long texts are many pieces. Pieces of equal length are
    ranked by doc_id, piece, checksum and row of the checkpoint within hash buckets, so a task that is run again ranks them the same.
    """
    rows = cut(pieces(docs, capacity, tokenizer))
    # capacity rows at most, whatever the corpus
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    def run(batches):
        by_length = runs.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            place, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.nonzero(np.diff(length[order]))[0] + 1):
                if len(own):
                    first, start, per, at = by_length[int(length[own[0]])].T
                    k = np.searchsorted(first, rank[own], "right") - 1
                    row, column = np.divmod(rank[own] - first[k], per[k])
                    place[own], offset[own] = start[k] + row, at[k] + column * length[own]
            yield batch(PLACED, sequence_id=pa.array(place), offset=pa.array(offset), **{n: b.column(n) for n in PIECES.names})

    return ranked(rows, sum(counts.values())).select(*PIECES.names, "rank").mapInArrow(run, COLUMNS + ", sequence_id long, offset long")
