"""Language-model scores by Brown's class-based bigrams.

A word's probability is that of its class after the class of the word before it, times that of the word in its class.
Exchange clustering assigns words to classes, in batches. The KERNEL most frequent words come first: each in turn
moves to the class that raises the likelihood of the training bigrams most, until none moves. Then all other words that the
training documents hold LEAST times or more, however many these are, move out of the class of the rare ones, each to
the class that raises the likelihood most, against the class statistics that the batch begins with: first those of the
dictionary that every worker holds (HEAD words), by the classes on both sides of them, then those beyond it, by the classes
before them. What remains, words of one occurrence or none, is a class for itself, and so is a document's end.

As what comes before, a word beyond the dictionary counts as a rare one, so that a document is scored in one pass and words
beyond the dictionary by one join, a row for each of them and class before it in a document.
All counts cover all training documents; those of contexts are sparse and grow with them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import batch, cut, keyed, sliced, text_bytes

#: Words that are clustered one after another, classes, words at most that every worker holds, and occurrences of a word that is clustered.
KERNEL, CLASSES, HEAD, LEAST = 1024, 64, 1 << 17, 2
#: Added to counts of words; prior weight of class frequencies in transitions; rounds of exchange at most.
ADD, WEIGHT, ROUNDS = 0.1, 10.0, 12
#: Different words, of so many bytes at most, that a task counts before it hands them on; longer ones are handed on at once. Contexts likewise.
COUNTED, LONGEST, BUFFER = 250_000, 64, 1 << 21
END = b""
PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
CLASSED = pa.schema([("w", pa.int64()), ("cls", pa.int32()), ("n", pa.int64())])
SCORED = "rid long, word binary, before int, n long, doc struct<doc_id: bigint, held_out: boolean, n_tokens: bigint, n_known: bigint, base: double, score: double>"


def held_out(doc_id: int | None) -> bool:
    """Whether a document isn't learnt from. A null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def number(word: bytes) -> int:
    """55 bits that stand for a word beyond the dictionary while it is clustered; Spark's xxhash64 gives the same."""
    return xxhash.xxh64_intdigest(word, 42) >> 9


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case and the end."""
    return [*text.lower().split(), END]


def training(rows: pa.RecordBatch) -> Iterator[list[bytes]]:
    for doc, text in zip(rows.column("doc_id").to_pylist(), text_bytes(rows.column("text"))):
        if not held_out(doc):
            yield tokens(text)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all training documents; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        told = lambda some: batch(WORDS, word=list(some.keys()), n=list(some.values()))
        for whole in batches:
            for rows in sliced(whole, 2 << 20):
                long: Counter = Counter()
                for words in training(rows):
                    if max(map(len, words)) > LONGEST:
                        long.update(w for w in words if len(w) > LONGEST)
                        words = [w for w in words if len(w) <= LONGEST]
                    seen.update(words)
                if long:
                    yield told(long)
                if len(seen) > COUNTED:
                    yield told(seen)
                    seen.clear()
        if seen:
            yield told(seen)

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, kernel: list[bytes]) -> DataFrame:
    """pair and n, for pairs of units: kernel words, any other word, the end. (KERNEL + 2) squared rows at most."""
    unit = {w: i for i, w in enumerate(kernel)} | {END: len(kernel) + 1}
    units, other = len(kernel) + 2, len(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, np.int64)
        for whole in batches:
            for rows in sliced(whole, 2 << 20):
                ids = [units - 1]
                for words in training(rows):
                    ids += [unit.get(w, other) for w in words]
                at = np.array(ids, np.int64)
                total += np.bincount(at[:-1] * units + at[1:], minlength=len(total))
        some = np.nonzero(total)[0]
        for part in np.array_split(some, max(1, len(some) >> 16)):
            yield batch(PAIRS, pair=pa.array(part), n=pa.array(total[part]))

    return docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Table:
    """The dictionary that every worker holds: its words, their classes, and the numbers of the classes for rare words and the end."""

    def __init__(self, head: list[tuple[bytes, int]], cls: np.ndarray, classes: int) -> None:
        self.index = {w: i for i, (w, _) in enumerate(head)} | {END: len(head)}
        self.classes, self.rare, self.end, self.many = classes, classes, classes + 1, classes + 2
        self.n = np.array([c for _, c in head], np.int64)
        self.cls = np.concatenate([cls, [self.end, self.rare]]).astype(np.int64)  # at -1, the class of words beyond the dictionary

    def at(self, words: list[bytes]) -> np.ndarray:
        """Places in the dictionary, -1 beyond it."""
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def counted(buffer: list[np.ndarray]) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate(buffer), return_counts=True)
    return batch(PAIRS, pair=pa.array(key), n=pa.array(n.astype(np.int64)))


def contexts(docs: DataFrame, table: Table, first: int) -> DataFrame:
    """pair and n: how often a dictionary word from place first on stands after a class (place * 2 * many + class) and before one (… + many + class)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Table = sent.value
        wanted = np.zeros(len(t.cls), bool)
        wanted[first : len(t.n)] = t.n[first:] >= LEAST
        buffer, size = [], 0
        for whole in batches:
            for rows in sliced(whole, 2 << 20):
                words = [END]
                for x in training(rows):
                    words += x
                at = t.at(words)
                cls = t.cls[at]
                own = np.nonzero(wanted[at])[0]  # never the first or the last, which are ends
                place = at[own] * (2 * t.many)
                buffer += [place + cls[own - 1], place + t.many + cls[own + 1]]
                size += 2 * len(own)
                if size > BUFFER:
                    yield counted(buffer)
                    buffer, size = [], 0
        if size:
            yield counted(buffer)

    return docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def class_pairs(docs: DataFrame, table: Table) -> DataFrame:
    """pair and n: of classes of dictionary words and the classes before them (-1 - (before * many + class)), and of words beyond it (number * many + before)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Table = sent.value
        dense = np.zeros(t.many * t.many, np.int64)
        buffer, size = [], 0
        for whole in batches:
            for rows in sliced(whole, 2 << 20):
                words = [END]
                for x in training(rows):
                    words += x
                at = t.at(words)
                cls = t.cls[at]
                beyond = at[1:] < 0
                dense += np.bincount((cls[:-1] * t.many + cls[1:])[~beyond], minlength=len(dense))
                far = np.nonzero(beyond)[0] + 1
                buffer.append(np.array([number(words[i]) for i in far.tolist()], np.int64) * t.many + cls[far - 1])
                size += len(far)
                if size > BUFFER:
                    yield counted(buffer)
                    buffer, size = [], 0
        if size:
            yield counted(buffer)
        some = np.nonzero(dense)[0]
        yield batch(PAIRS, pair=pa.array(-1 - some), n=pa.array(dense[some]))

    return docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def by_word(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (pair, n), sorted by pair, as words, and for each row the place of its word among them, its code and its number; no word is cut in two."""
    tail = np.empty((0, 2), np.int64)
    for b in batches:
        now = np.concatenate([tail, np.stack([b.column("pair").to_numpy(), b.column("n").to_numpy()], axis=1)])
        if not len(now):
            continue
        last = int(np.searchsorted(now[:, 0], now[-1, 0] // width * width))
        tail, now = now[last:], now[:last]
        if len(now):
            words, place = np.unique(now[:, 0] // width, return_inverse=True)
            yield words, place, now[:, 0] % width, now[:, 1]
    if len(tail):
        words, place = np.unique(tail[:, 0] // width, return_inverse=True)
        yield words, place, tail[:, 0] % width, tail[:, 1]


def chosen(place: np.ndarray, code: np.ndarray, n: np.ndarray, words: int, gain: np.ndarray) -> np.ndarray:
    """The best class of each word: gain[code, class] is what one context of a code adds to the likelihood in a class."""
    best = np.empty(words, np.int64)
    edge = np.searchsorted(place, np.arange(words + 1))
    for at in range(0, words, 512):
        to = min(words, at + 512)
        rows = slice(edge[at], edge[to])
        total = np.add.reduceat(gain[code[rows]] * n[rows, None], edge[at:to] - edge[at], axis=0)
        best[at:to] = total.argmax(1)
    return best


def moved(pairs: DataFrame, width: int, gain: np.ndarray, many: int = 0) -> DataFrame:
    """w, cls and n of contexts by word: each word's class by the gains of its contexts. Words are spread over tasks; only sums by word meet.

    With many, words of fewer than LEAST occurrences stay with the rare ones, of class many - 2, and there are rows of sums by
    class before and class, with w = -1 - (before * many + class), besides. n counts contexts, of both sides where there are both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, place, code, n in by_word(batches, width):
            best = chosen(place, code, n, len(words), gain)
            total = np.bincount(place, n, len(words)).astype(np.int64)
            if many:
                best[total < LEAST] = many - 2
                sums = np.bincount(code * many + best[place], n, many * many).astype(np.int64)
                some = np.nonzero(sums)[0]
                yield batch(CLASSED, w=pa.array(-1 - some), cls=pa.array(np.full(len(some), -1, np.int32)), n=pa.array(sums[some]))
            yield batch(CLASSED, w=pa.array(words), cls=pa.array(best.astype(np.int32)), n=pa.array(total))

    spread = pairs.repartition(F.call_function("div", F.col("pair"), F.lit(width).cast("bigint"))).sortWithinPartitions("pair")
    return spread.mapInArrow(run, "w long, cls int, n long")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of all units of a matrix of pair counts; the first words units are clustered, each other one is a class.

    Starts with words dealt to classes by frequency. One exchange takes time in the square of the
    classes; the sum over pairs of classes of n log n, less 2 n log n of the classes, rises with each.
    """
    units = len(pairs)
    classes = min(classes, max(1, words))
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(units - words)]).astype(np.int64)
    many = classes + units - words
    onto = np.zeros((units, many))
    onto[np.arange(units), of] = 1
    right, left = pairs @ onto, pairs.T @ onto  # of each unit: its counts before and after each class
    between = onto.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            a, r, l, own = of[w], right[w], left[w], pairs[w, w]
            # Without w: its class's row and column lose its counts, and itself twice where both meet.
            r0, l0 = r.copy(), l.copy()
            r0[a] -= own
            l0[a] -= own
            between[a] -= r0
            between[:, a] -= l0
            between[a, a] -= own
            # Wherever w goes, what precedes or follows it counts for the other classes.
            out, into = between.sum(1) + l0, between.sum(0) + r0
            rows, columns = between[:classes], between[:, :classes].T
            gain = (xlogx(rows + r0) - xlogx(rows)).sum(1) + (xlogx(columns + l0) - xlogx(columns)).sum(1)
            d = np.arange(classes)
            corner = between[d, d]
            gain += xlogx(corner + r0[d] + l0[d] + own) - xlogx(corner + r0[d]) - xlogx(corner + l0[d]) + xlogx(corner)
            n_out, n_in = r0.sum() + own, l0.sum() + own
            gain -= xlogx(out[d] + n_out) - xlogx(out[d]) + xlogx(into[d] + n_in) - xlogx(into[d])
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 * abs(gain[a]) + 1e-9 else a
            between[b] += r0
            between[:, b] += l0
            between[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return of


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each, from their counts, drawn towards the classes' frequencies."""
    share = (counts.sum(0) + ADD) / (counts.sum() + ADD * len(counts))
    return np.log10((counts + WEIGHT * share) / (counts.sum(1, keepdims=True) + WEIGHT))


class Model:
    """What workers need: the dictionary with its classes and logarithms, and the transitions."""

    def __init__(self, table: Table, counts: np.ndarray, size: np.ndarray, kinds: np.ndarray, total: int, distinct: int) -> None:
        self.table, self.total, self.distinct = table, total, distinct
        self.denominator = total + ADD * (distinct + 1)
        self.trans = transitions(counts)
        #: Of each class, what its words share: their counts and ADD for each of them; for the rare ones' class one more, of words never seen.
        self.room = np.maximum(size + ADD * (kinds + (np.arange(table.many) == table.rare)), ADD)  # ADD only where there is no word
        n = np.concatenate([table.n, [size[table.end]]])
        self.base = np.log10((n + ADD) / self.denominator)
        self.emit = np.log10((n + ADD) / self.room[table.cls[:-1]])
        self.known = n > 0


def frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the highest counts, most of them at most, without sorting the rest.

    Counts fall into bands of a sixteenth of a doubling, about a thousand of them whatever the corpus; bands are taken
    whole from the top while they fit. Then by count, and by word.
    """
    band = F.floor(16 * F.log2("n")).cast("int")
    sizes = sorted(words.groupBy(band.alias("b")).count().collect(), reverse=True)
    least, total, part, more = 1 << 30, 0, 0, 1
    for b, n in sizes:
        if total + n > most:
            # Of the band that doesn't fit, those whose checksum is a multiple, so that the room is used whatever the counts.
            part, more = b, -(-2 * n // max(1, most - total))
            break
        least, total = b, total + n
    wanted = band >= least
    if more > 1 and total < most:
        wanted = wanted | ((band == part) & (F.pmod(F.crc32("word"), F.lit(more)) == 0))
    got = words.filter(wanted).select("word", "n").toArrow()
    return sorted(zip(got["word"].to_pylist(), got["n"].to_pylist()), key=lambda x: (-x[1], x[0]))[:most]


def square(rows: list[tuple[int, int]], units: int) -> np.ndarray:
    out = np.zeros(units * units)
    for pair, n in rows:
        out[pair] = n
    return out.reshape(units, units)


def learn(docs: DataFrame, counts: DataFrame, kernel: int = KERNEL, head: int = HEAD, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of keyed() documents and their word_counts(); and word, c and cls of all words beyond its dictionary that are clustered."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = frequent(counts.filter(F.length("word") > 0), head)
    core = [w for w, n in top[:kernel] if n >= LEAST]
    units, classes = len(core) + 2, min(classes, max(1, len(core)))
    got = pair_counts(docs, core).toArrow()  # units squared rows at most, 16 bytes each
    pairs = square(zip(got["pair"].to_pylist(), got["n"].to_pylist()), units)
    of = exchange(pairs, len(core), classes)
    onto = np.zeros((units, classes + 2))
    onto[np.arange(units), of] = 1
    table = Table(top, np.concatenate([of[: len(core)], np.full(len(top) - len(core), classes)]), classes)
    # The second batch: the rest of the dictionary, by what its words stand after and before.
    begun = onto.T @ pairs @ onto
    trans, room = transitions(begun), np.log10(begun.sum(0) + ADD)
    gain = np.concatenate([trans[:, :classes] - room[None, :classes], trans.T[:, :classes]])
    dictionary = moved(contexts(docs, table, len(core)), 2 * table.many, gain).toArrow()  # HEAD rows at most
    table.cls[dictionary["w"].to_numpy()] = dictionary["cls"].to_numpy()
    # The third: all words beyond it, by what they stand after, against what the dictionary's classes have become.
    rows = cut(class_pairs(docs, table))
    dense = square([(-1 - p, n) for p, n in rows.filter("pair < 0").collect()], table.many)  # many squared rows at most
    trans, room = transitions(dense), np.log10(dense.sum(0) + ADD)
    classed = cut(moved(rows.filter("pair >= 0"), table.many, trans[:, :classes] - room[None, :classes], table.many))
    dense += square([(-1 - w, n) for w, n in classed.filter("w < 0").groupBy("w").agg(F.sum("n")).collect()], table.many)
    size, kinds = dense.sum(0), np.bincount(table.cls[:-1], minlength=table.many).astype(float)
    beyond = counts.join(classed.filter("w >= 0").select("w", "cls"), F.shiftrightunsigned(F.xxhash64("word"), 9) == F.col("w")).select("word", F.col("n").alias("c"), "cls")
    beyond = cut(beyond)
    for cls, n in beyond.groupBy("cls").count().collect():  # many rows
        kinds[cls] += n
    return Model(table, dense, size, kinds, total or 0, distinct), beyond


def partial_scores(docs: DataFrame, model: Model) -> DataFrame:
    """For each document a row with doc, its sums over words of the dictionary, and one for each other word and class before it.

    A document's own row has as its word the blank and its row id, which no word equals, so these rows spread over all partitions.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    row = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    schema = pa.schema([("rid", pa.int64()), ("word", pa.binary()), ("before", pa.int32()), ("n", pa.int64()), ("doc", row)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        t = m.table
        for whole in batches:
            for rows in sliced(whole, 2 << 20):
                out: tuple[list, ...] = ([], [], [], [], [])
                put = lambda *x: [a.append(b) for a, b in zip(out, x)]
                for rid, doc, text in zip(rows.column("rid").to_pylist(), rows.column("doc_id").to_pylist(), text_bytes(rows.column("text"))):
                    words = tokens(text)
                    at = t.at(words)
                    cls = t.cls[at]
                    before = np.concatenate([[t.end], cls[:-1]])
                    near = at >= 0
                    own = at[near]
                    score = float(m.trans[before[near], cls[near]].sum() + m.emit[own].sum())
                    told = {"doc_id": doc, "held_out": held_out(doc), "n_tokens": len(words), "n_known": int(m.known[own].sum()), "base": float(m.base[own].sum()), "score": score}
                    put(rid, b" %d" % rid, -1, 0, told)
                    far = np.nonzero(~near)[0]
                    for (w, c), n in Counter((words[i], c) for i, c in zip(far.tolist(), before[far].tolist())).items():
                        put(rid, w, c, n, None)
                yield batch(schema, rid=out[0], word=out[1], before=out[2], n=out[3], doc=pa.array(out[4], row))

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, SCORED)


def scores(docs: DataFrame, kernel: int = KERNEL, head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity, one row for each row of docs.

    A null or empty text is its end alone. A null doc_id counts as held out. Repeated rows are learnt
    from and scored each. Very long texts are single rows that are counted and scored whole. No training documents: all
    counts are 0. An empty table gives an empty result. Other columns are ignored.
    """
    rows = keyed(docs)
    counts = cut(word_counts(rows))
    model, beyond = learn(rows, counts, kernel, head, classes)
    t, spark = model.table, docs.sparkSession
    # many squared rows: what a word of a class adds after a class, without its own count.
    steps = model.trans - np.log10(model.room)[None, :]
    step = spark.createDataFrame([(h, c, float(steps[h, c])) for h in range(t.many) for c in range(t.many)], "h int, to int, step double")
    # Words beyond the dictionary with their counts; those that aren't clustered, and unseen ones, are rare.
    rare = counts.join(beyond.select(F.col("word").alias("v"), "cls"), F.col("word") == F.col("v"), "left").select(F.col("word").alias("w"), F.col("n").alias("c"), "cls")
    joined = partial_scores(rows, model).join(rare, F.col("word") == F.col("w"), "left").withColumn("k", F.coalesce("cls", F.lit(t.rare)))
    joined = joined.join(F.broadcast(step), (F.col("before") == F.col("h")) & (F.col("k") == F.col("to")), "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    many = F.col("n") * F.log10(c + ADD)
    own = joined.groupBy("rid").agg(F.max("doc").alias("d"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(many - F.col("n") * F.log10(F.lit(model.denominator))).alias("base"), F.sum(F.when(F.col("n") > 0, many + F.col("n") * F.col("step")).otherwise(0.0)).alias("score"))
    score = F.col("d.score") + F.col("score")
    return own.select(
        "d.doc_id", "d.held_out", "d.n_tokens", (F.col("d.n_known") + F.col("known")).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("d.base") + F.col("base")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("d.n_tokens")).alias("perplexity"),
    )
