"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, schemes, digits, plus signs and cues of
identifiers. From each anchor a deterministic parser expands to the left and right, finds the
boundaries and validates what lies between. No pattern is tried at every position of a text.

Kinds of the base contract, each leftmost and non-overlapping, dropped without retry if it fails:
email, ip, card, phone. Kinds that the anchors add, each with a validation of its own:
account (after a cue such as "iban" or "account number": an IBAN with the right check digits, or
8 to 17 digits), ssn (after a cue: 3-2-4 digits in the ranges that are given out), login (user:password@
after a scheme) and hidden_email ("name [at] host [dot] tld" with brackets around both words). A cue is followed by
one to four blanks or marks (: # . = -) and then by what it names: that is its grammar, as three groups of digits are an ssn's.

Defined results: a null or empty text has no spans; very long texts are searched whole, in time linear in their length; spans are in code points with exclusive ends; equal
rows give equal results; other columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import batch, ids_of, keyed, map_batches, sliced, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "ssn", "login", "hidden_email")
DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = LABEL | frozenset("._%+")
ALNUM = LABEL - {"-"}
CARD_GAP, PHONE_INNER = frozenset(" -"), DIGITS | frozenset(" ().-")
#: Cues, in lower case.
ACCOUNT_CUES = ("iban", "account number", "account no", "account", "acct", "kontonummer", "konto", "compte", "cuenta")
SSN_CUES = ("social security number", "social security", "ssn")
AT_WORDS, DOT_WORDS = ("[at]", "(at)", "{at}"), ("[dot]", "(dot)", "{dot}")
#: Characters between a cue and what it names, and how many of them there may be.
AFTER_CUE, REACH = frozenset(" :#.=-\t"), 4
#: The longest account there is: 34 characters, with a space between any two.
WIDEST = 67
AUTHORITY = re.compile(r"[^/?#\s]*")
SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def automaton() -> ahocorasick.Automaton:
    """Anchors to (sort, length). Texts are searched in lower case, of the same length."""
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for sort, words in (("account", ACCOUNT_CUES), ("ssn", SSN_CUES), ("hidden", AT_WORDS)):
        for w in words:
            a.add_word(w, (sort, len(w)))
    a.make_automaton()
    return a


#: A-Z to a-z and nothing else, so that positions stay.
LOWER = {i: i + 32 for i in range(65, 91)}


def anchors(text: str, machine: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """By sort, the anchors' (start, end) from left to right; digits as whole runs."""
    out: dict[str, list[tuple[int, int]]] = {s: [] for s in ("at", "plus", "scheme", "account", "ssn", "hidden")}
    runs: list[tuple[int, int]] = []
    for last, (sort, n) in machine.iter(text.translate(LOWER)):
        if sort != "digit":
            out[sort].append((last + 1 - n, last + 1))
        elif runs and runs[-1][1] == last:
            runs[-1] = (runs[-1][0], last + 1)
        else:
            runs.append((last, last + 1))
    out["runs"] = runs
    return out


def run_left(text: str, end: int, allowed: frozenset, least: int = 0) -> int:
    """Where the run of allowed characters that ends at end begins, not before least."""
    while end > least and text[end - 1] in allowed:
        end -= 1
    return end


def run_right(text: str, start: int, allowed: frozenset) -> int:
    n = len(text)
    while start < n and text[start] in allowed:
        start += 1
    return start


def emails(text: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Local part, at-sign, and two labels or more; the host ends after its last label."""
    out, free = [], 0
    for i, after in at:
        start = run_left(text, i, LOCAL, free) if i >= free else i
        if start == i:
            continue
        end, labels = run_right(text, after, LABEL), 1
        if end == after:
            continue
        while end < len(text) and text[end] == "." and (more := run_right(text, end + 1, LABEL)) > end + 1:
            end, labels = more, labels + 1
        if labels > 1:
            out.append((start, end))
            free = end
    return out


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four runs of digits joined by single dots, taken from the left; then each part is at most 255."""
    out, k = [], 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(int(text[a:b][-400:]) <= 255 if b - a <= 400 else not text[a:b].strip("0") for a, b in four):
                out.append((four[0][0], four[3][1]))
            k += 4
        else:
            k += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Digits with at most one space or hyphen between any two: 12 to 19 with a right check digit."""
    out, k = [], 0
    while k < len(runs):
        j = k
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in CARD_GAP:
            j += 1
        n = sum(b - a for a, b in runs[k : j + 1])
        if 12 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[k : j + 1])):
            out.append((runs[k][0], runs[j][1]))
        k = j + 1
    return out


def phones(text: str, plus: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A plus sign and a digit, then digits, spaces, brackets, dots and hyphens up to the last digit; 9 to 15 digits."""
    out, free = [], 0
    for i, after in plus:
        if i < free or after >= len(text) or text[after] not in DIGITS:
            continue
        end = run_right(text, after, PHONE_INNER)
        while text[end - 1] not in DIGITS:
            end -= 1
        if end - after < 3:  # the first digit, one character or more, and the last digit
            continue
        free = end
        if 9 <= sum(c in DIGITS for c in text[after:end]) <= 15:
            out.append((i, end))
    return out


def iban(x: str) -> bool:
    """Country, check digits and 11 to 30 more characters that leave 1 modulo 97."""
    if not (15 <= len(x) <= 34 and x[:2].isalpha() and x[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def after_cue(text: str, end: int) -> int:
    """Where the thing begins that a cue names, or -1."""
    stop = min(len(text), end + REACH)
    at = end
    while at < stop and text[at] in AFTER_CUE:
        at += 1
    return at if end < at < len(text) else -1


def alone(text: str, start: int) -> bool:
    """A cue begins a word."""
    return start == 0 or not text[start - 1].isalnum()


def accounts(text: str, cues: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, free = [], 0
    for a, b in cues:
        at = after_cue(text, b)
        if at < free or at < 0 or not alone(text, a):
            continue
        end = at
        while end < len(text) and end - at < WIDEST and (text[end] in ALNUM or text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM):
            end += 1
        whole = end == len(text) or text[end] not in ALNUM
        for stop in [*([end] if whole else []), *(i for i in range(end - 1, at, -1) if text[i] == " ")]:
            raw = text[at:stop].replace(" ", "")
            if iban(raw.upper()) or raw.isdigit() and raw.isascii() and 8 <= len(raw) <= 17:
                out.append((at, stop))
                free = stop
                break
    return out


def ssns(text: str, cues: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, free = [], 0
    for a, b in cues:
        at = after_cue(text, b)
        if at < free or at < 0 or not alone(text, a):
            continue
        x = text[at : at + 11]
        parts = x.split("-")
        if [len(p) for p in parts] == [3, 2, 4] and all(p.isdigit() and p.isascii() for p in parts) and (at + 11 == len(text) or text[at + 11] not in LABEL):
            if parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000":
                out.append((at, at + 11))
                free = at + 11
    return out


def logins(text: str, schemes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """user:password between a scheme and the last at-sign of its authority, which ends before /, ?, # or white space, however far that is."""
    out = []
    for a, b in schemes:
        if a == 0 or text[a - 1] not in ALNUM:
            continue
        at = text.rfind("@", b, AUTHORITY.match(text, b).end())
        if ":" in text[b + 1 : max(b, at - 1)]:
            out.append((b, at))
    return out


def hidden_emails(text: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, free = [], 0
    for a, b in at:
        right = a - 1 if a and text[a - 1] == " " else a
        start = run_left(text, right, LOCAL, free) if right >= free else right
        begin = b + 1 if text[b : b + 1] == " " else b
        end = run_right(text, begin, LABEL)
        if start == right or end == begin:
            continue
        labels = 1
        while True:
            dot = end + 1 if text[end : end + 1] == " " else end
            word = next((w for w in DOT_WORDS if text[dot : dot + len(w)].lower() == w), "." if dot == end and text[end : end + 1] == "." else "")
            if not word:
                break
            more = dot + len(word)
            more += word != "." and text[more : more + 1] == " "
            if (stop := run_right(text, more, LABEL)) == more:
                break
            end, labels = stop, labels + 1
        if labels > 1:
            out.append((start, end))
            free = end
    return out


def spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then in the order of KINDS."""
    found = anchors(text, machine)
    if not any(found.values()):
        return []
    by = {
        "email": emails(text, found["at"]),
        "ip": ips(text, found["runs"]),
        "card": cards(text, found["runs"]),
        "phone": phones(text, found["plus"]),
        "account": accounts(text, found["account"]),
        "ssn": ssns(text, found["ssn"]),
        "login": logins(text, found["scheme"]),
        "hidden_email": hidden_emails(text, found["hidden"]),
    }
    return sorted(((a, b, k) for k, places in by.items() for a, b in places), key=lambda x: (x[0], KINDS.index(x[2])))


def told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and all spans, one row for each row of docs."""

    def make():
        machine = automaton()

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans(x or "", machine) for x in rows.column("text").to_pylist()]
            base = [[x for x in s if x[2] in BASE] for s in found]
            counts = {f"n_{k}": [sum(x[2] == k for x in s) for s in base] for k in BASE}
            digests = [hashlib.sha256(told(s).encode()).hexdigest() for s in base]
            return batch(SPANS, doc_id=ids_of(rows), base_sha256=digests, spans=[told(s) for s in found], **counts)

        return f

    return map_batches(keyed(docs), ["doc_id", "text"], make, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def masked(text: str, machine: ahocorasick.Automaton) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind in brackets."""
    out, free = [], 0
    merged: list[list] = []
    for a, b, k in spans(text, machine):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[free:a], f"[{k.upper()}]"]
        free = b
    return "".join([*out, text[free:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with all their columns, personal data in text masked and n_chars, if there is one, counted anew. Texts without any stay as they are, null too."""
    fields = docs.schema

    def run(batches):
        machine = automaton()
        for whole in batches:
            for rows in sliced(whole):
                old = rows.column("text").to_pylist()
                new = [x if x is None else masked(x, machine) for x in old]
                columns = {n: rows.column(n) for n in rows.schema.names}
                columns["text"] = pa.array(new, rows.schema.field("text").type)
                if "n_chars" in columns:
                    kind = rows.schema.field("n_chars").type
                    sizes = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new)]
                    columns["n_chars"] = pa.array(sizes, kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=rows.schema)

    return docs.mapInArrow(tidy(run), fields)
