"""Token ids by the public tokenizer libraries, and counts for huge texts by overlap resynchronisation.

word_bpe_49k.json never joins characters across the six ASCII separators: its normaliser turns each
run of white space into one blank, its pattern matches no white space, and neither special token holds
any. The ids of a text are therefore those of its ASCII-separated words, one after another, and the
library is asked about each different word once (see Words).
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import public_tokenizers
from tokenizers import Tokenizer

from provspark.llm.common import remembered

WORD_BPE = "word_bpe_49k.json"
#: Words whose ids one worker remembers, and their bytes with their ids, before it forgets all and starts anew; bytes of a word that is remembered at all.
MEMORY, MEMORY_BYTES, LONGEST = 1_000_000, 64 << 20, 64
#: Marks that are a token of their own after an ASCII letter or digit.
LAST_MARKS = frozenset(b".,;:!?")
ASCII_WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Marks after which a letter begins a new piece, whatever else stands around: the pattern joins no letter to a mark but the apostrophe.
STOPS = frozenset(".,;:!?\u3001\u3002\uff0c\uff1a\uff1b\uff01\uff1f")
#: Characters of a text beyond which it counts as huge, of its chunks, and of the first overlap.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 14, 128


def word_bpe(path: str = "") -> Tokenizer:
    t = Tokenizer.from_file(path or public_tokenizers.path(WORD_BPE))
    t.no_truncation()
    t.no_padding()
    return t


class Words:
    """Ids of words as little-endian unsigned 32-bit numbers, remembered."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.known, self.size = tokenizer, {}, 0

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text's UTF-8, four bytes each."""
        return self.many([text])[0]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts; the library is asked about all their new words at once."""
        # The library lower-cases by itself. Doing it first for ASCII only saves memory, but would
        # make special tokens of their upper-case forms, and could compose marks that it doesn't.
        split = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts]
        found = [[*map(self.known.get, words)] for words in split]
        new = {w for words, ids in zip(split, found) if None in ids for w, i in zip(words, ids) if i is None}
        if new:
            # What is found is at hand already; only later texts ask again for what is forgotten.
            fresh = self.learn(list(new))
            for words, ids in zip(split, found):
                if None in ids:
                    ids[:] = [fresh[w] if i is None else i for w, i in zip(words, ids)]
        return [b"".join(ids) for ids in found]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words; of one with a last mark, the library is asked about what stands before the mark. All but long ones are remembered."""
        if len(self.known) + len(words) > MEMORY or self.size > MEMORY_BYTES:
            self.known, self.size = {}, 0
        known, out = self.known, {}
        marked = {w for w in words if len(w) > 1 and w[-1] in LAST_MARKS and w[-2] in ASCII_WORD}
        plain = [w for w in words if w not in marked]
        plain += {x for w in marked for x in (w[:-1], w[-1:]) if x not in known}.difference(plain)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                out[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        for w in marked:
            out[w] = b"".join(out[x] if x in out else known[x] for x in (w[:-1], w[-1:]))
        for w, ids in out.items():
            if len(w) <= LONGEST:
                known[w] = ids
                self.size += len(w) + len(ids)
        return out


def shared_words(path: str = "") -> Words:
    """The words that this worker process remembers from one task to the next, until a step comes that needs none."""
    return remembered(f"words {path}", lambda: Words(word_bpe(path)))


class OutOfStep(Exception):
    """Two encodings of an overlap share no proven boundary."""


def boundaries(text: str, begin: int, spans: list[tuple[int, int]]) -> list[int]:
    """Positions, in text, where a token of a chunk that begins at begin starts right after a blank, or is a letter after one of STOPS.

    Such a position is stable: no token, whatever stands further to the left or right, goes across it. The normaliser
    composes no mark with a letter after it, the pattern ends a run of marks before a letter, and special tokens hold
    neither blanks nor STOPS. The chunk's own first token is left out, as the chunk may have cut it.
    """
    return [begin + a for a, _ in spans[1:] if (c := text[begin + a - 1]) in " \t\n\x0b\x0c\r" or c in STOPS and text[begin + a].isalpha()]


def splice(text: str, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a long text, from overlapping chunks.

    Each chunk begins overlap characters before the end of the one before. Both encodings of the
    overlap are cut at a stable boundary that they share, and that both reach with the same tokens
    after it up to the next one; if there is none, the overlap is doubled, in the end to the whole
    text so far, and the chunk encoded again. An overlap that was needed is kept, and chunks are no shorter than
    it, so a text without any boundary costs a few encodings of the whole, not one of each prefix.
    """
    ids: list[int] = []
    spans: list[tuple[int, int]] = []  # of ids, in text
    end, wide = 0, overlap
    while end < len(text):
        begin = max(0, end - wide) if end else 0
        stop = min(len(text), end + max(chunk, wide))
        e = tokenizer.encode(text[begin:stop], add_special_tokens=False)
        if begin == 0:
            ids, spans = list(e.ids), list(e.offsets)
        else:
            try:
                i, j = common(text, spans, begin, e.offsets, ids, e.ids)
            except OutOfStep:
                wide = min(2 * wide, end)
                continue
            ids[i:], spans[i:] = e.ids[j:], [(begin + a, begin + b) for a, b in e.offsets[j:]]
        end = stop
    return ids


def common(text: str, spans: list[tuple[int, int]], begin: int, new: list[tuple[int, int]], old_ids: list[int], new_ids: list[int]) -> tuple[int, int]:
    """Positions in the old and the new tokens of the first shared stable boundary with equal tokens up to the next."""
    starts = [a for a, _ in spans[bisect_left(spans, (begin, 0)) :]]
    shift = len(spans) - len(starts)
    old = {a: shift + k for k, a in reversed(list(enumerate(starts)))}
    fresh = {begin + a: k for k, (a, _) in reversed(list(enumerate(new)))}
    both = [p for p in boundaries(text, begin, new) if p in old]
    for p, q in zip(both, both[1:]):
        if old_ids[old[p] : old[q]] == new_ids[fresh[p] : fresh[q]]:
            return old[p], fresh[p]
    raise OutOfStep


def counts(texts: list[bytes], words: Words, huge: int = HUGE) -> list[int]:
    """Tokens of each text's UTF-8."""
    short = iter(id_lists([t for t in texts if len(t) <= huge], words))
    return [len(splice(t.decode(), words.tokenizer)) if len(t) > huge else len(next(short)) // 4 for t in texts]


def id_lists(texts: list[bytes], words: Words, most: int = 1 << 19) -> Iterator[bytes]:
    """The ids of texts, of about most bytes at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size, end = size + len(texts[end]), end + 1
        yield from words.many(texts[at:end])
        at = end
