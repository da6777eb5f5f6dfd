"""Token counts against the library on whole texts; packing against best fit, piece after piece."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import packing, token_counts, tokens

TOKENIZER = tokens.word_bpe()
WORDS = tokens.Words(TOKENIZER)
whole = lambda t: TOKENIZER.encode(t, add_special_tokens=False).ids
PIECES = ["the", "The", "don't", "'S", "É", "é", "H̱", "İ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "a1", "12", "!!", "\xa0", "\x1c", "\x85", "　", "漢字", "😀", " ", "  ", "\n", "\t", "\x0b", "ﬁ", "x" * 30, ".", "。", "，", "！", "漢", "한", "\u1100", "\u1161", "\u0301", ".a", "?\u0301a", ":'s", "ǅ", "ª", "\u02b0"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
def test_ids_equal_library(text):
    got = WORDS.ids(text.encode())
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == whole(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 7)
    words, r = tokens.Words(TOKENIZER), random.Random(9)
    for _ in range(60):
        text = " ".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))
        assert words.ids(text.encode()) == b"".join(i.to_bytes(4, "little") for i in whole(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=90).map("".join), st.integers(3, 40), st.integers(1, 12))
def test_splice_equals_library(text, chunk, overlap):
    assert tokens.splice(text, TOKENIZER, chunk, overlap) == whole(text)


def test_huge_texts():
    r = random.Random(2)
    for text in ("x" * 40_000, "é!" * 20_000, " ".join(r.choice(PIECES) for _ in range(30_000)), " " * 50_000, "ab" * 9000 + " " + "cd " * 9000):
        assert tokens.counts([b"a b", text.encode()], WORDS, 1 << 15) == [2, len(whole(text))]


class Costed:
    """The tokenizer, and how many characters it was asked about."""

    def __init__(self):
        self.asked = 0

    def encode(self, text, **how):
        self.asked += len(text)
        return TOKENIZER.encode(text, **how)


def test_cost_is_linear_without_blanks():
    r = random.Random(3)
    han = [chr(x) for x in range(0x4E00, 0x4E00 + 3000)]
    runs = "".join(r.choice(han) for _ in range(200_000))
    sentences = "".join("".join(r.choice(han) for _ in range(r.randint(5, 40))) + r.choice("。，！") for _ in range(9000))
    for text, most in ((runs, 10), (sentences, 1.2), ("x" * 200_000, 10), ("a, b" * 50_000, 1.2)):
        cost = Costed()
        assert tokens.splice(text, cost) == whole(text)
        assert cost.asked <= most * len(text)


def test_long_words_are_not_remembered(monkeypatch):
    words = tokens.Words(TOKENIZER)
    for i in range(50):
        text = f"{'漢字' * 400}{i} short"
        assert words.ids(text.encode()) == b"".join(x.to_bytes(4, "little") for x in whole(text))
    assert set(words.known) == {b"short"}
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 2000)
    for i in range(2000):
        words.ids(f"w{i} v{i}".encode())
        assert words.size <= 2000 + 64
    assert len(words.known) < 300


def single(lengths: list[int], capacity: int) -> list[int]:
    """Remainders of all bins after best fit decreasing, one piece at a time."""
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= x]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - x)
        else:
            bins.append(capacity - x)
    return sorted(bins)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_equals_single_placement(lengths):
    runs = packing.plan(Counter(lengths), 40)
    used = defaultdict(list)
    for x, n in Counter(lengths).items():
        for rank in range(n):
            first, start, per, at = [r for r in runs[x].tolist() if r[0] <= rank][-1]
            used[start + (rank - first) // per].append((at + (rank - first) % per * x, x))
    for b in used.values():
        place = 0
        for at, x in sorted(b):
            assert at == place
            place += x
        assert place <= 40
    assert sorted(40 - sum(x for _, x in b) for b in used.values()) == single(lengths, 40)


def test_rows(spark):
    long = " ".join(f"word{i % 700}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, long), (4, long), *((i, f"doc {i} " * (i % 9)) for i in range(10, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "'a' AS n_tokens", "2 AS rank")
    got = packing.packed(docs).collect()
    want = Counter()
    for d, t in rows:
        ids = [*whole(t or ""), 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == len(single([x[3] for x in want.elements()], 2048))
    assert packing.packed(docs.limit(0)).count() == 0
    counts = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(docs).collect()))
    assert counts == sorted((d or 0, len((t or "").encode()), len(whole(t or "")), len(whole(t or "")) > 2048) for d, t in rows)
