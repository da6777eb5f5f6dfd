"""Personal data: against the patterns of the base contract, and the added kinds by example."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import pii

MACHINE = pii.automaton()


def base(text: str) -> list[tuple[int, int, str]]:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    out = [(*m.span(), k) for k, (p, good) in rules.items() for m in re.finditer(p, text) if good(m)]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


PIECES = st.sampled_from(["a", "B", "@", ".", "..", "-", "+", " ", "  ", "1", "22", "255", "256", "4111111111111111", "(", ")", "x.com", "@@", "é", "٣", "_", "%", "\n", "+1", "192.168.0.1", "00000"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=24).map("".join))
def test_base_equals_patterns(text):
    assert [x for x in pii.spans(text, MACHINE) if x[2] in pii.BASE] == base(text)


def test_added_kinds():
    found = lambda t: {t[a:b]: k for a, b, k in pii.spans(t, MACHINE) if k not in pii.BASE}
    assert found("IBAN: GB82 WEST 1234 5698 7654 32 paid") == {"GB82 WEST 1234 5698 7654 32": "account"}
    assert found("iban GB82 WEST 1234 5698 7654 33") == {}
    assert found("account number: 12345678.") == {"12345678": "account"}
    assert found("On account of 1234567890123") == {}
    assert found("SSN 123-45-6789, ssn: 000-12-3456") == {"123-45-6789": "ssn"}
    assert found("ftp://bob:secret@host/x http://a.b/c@d") == {"bob:secret": "login"}
    assert found("write bob [at] mail (dot) org now") == {"bob [at] mail (dot) org": "hidden_email"}
    assert found("we met (at) noon") == {}


def test_rows(spark):
    r = random.Random(3)
    long = "".join(r.choice(["word ", "a@b.co ", "10.0.0.1, ", "+49 30 1234567; "]) for _ in range(60_000))
    rows = [(1, None, 0), (2, "", 0), (3, "mail a@b.co, b@c.de", 9), (3, "mail a@b.co, b@c.de", 9), (None, long, len(long)), (4, "clean text", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'x' AS spans", "1 AS n_email")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    for g, (d, t, _) in zip(got, rows):
        want = base(t or "")
        assert (g.doc_id, g.n_email, g.base_sha256) == (d, sum(x[2] == "email" for x in want), hashlib.sha256(pii.told(want).encode()).hexdigest())
    clean = pii.redact(docs)
    assert clean.schema == docs.schema
    out = [(r.doc_id, r.text, r.n_chars) for r in clean.collect()]
    assert out[0] == (1, None, 0) and out[2] == (3, "mail [EMAIL], [EMAIL]", 21) and out[5] == (4, "clean text", 10)
    assert pii.find(docs.limit(0)).count() == 0


def test_grammars_without_caps():
    machine = pii.automaton()
    got = lambda t: [(t[a:b], k) for a, b, k in pii.spans(t, machine) if k in ("login", "account")]
    secret = "p" * 5000
    assert got(f"see ftp://user:{secret}@host.example/x") == [(f"user:{secret}", "login")]
    assert got("http://a:b@c@host/ and http://x/y:z@w and https://none@host and s://u:p#@h") == [("a:b@c", "login")]
    spaced = " ".join("GB82WEST12345698765432")
    assert got(f"IBAN: {spaced}, thanks") == [(spaced, "account")]
    assert got("account 12345678 " + "x" * 300) == [("12345678", "account")] and got("account " + "1" * 300) == []
