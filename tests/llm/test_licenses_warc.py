"""Canonical digests by example; WARC derivatives as round trips."""

import gzip
import os
import textwrap

import pytest
from pyspark.sql import functions as F

from provspark.llm import license_texts
from provspark.llm import licenses as L
from provspark.llm import warc as W


def test_scan(spark):
    texts = [None, "", " \n ", "Released under the MIT License.", "released UNDER -- the mit licence\n", "Copyright 2020 A. Person\n(c) B\nReleased under\nthe MIT License!", "Some text.\nLicensed under the Apache License, v2.0\nReleased under the MIT License\nReleased under the MIT License", "Not released under the MIT license", "x " * 60_000 + "\nLicenced under CC BY-NC 4.0", "Copyright only"]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS license_id", "3 AS rid")
    got = sorted(map(tuple, L.scan(docs).collect()), key=str)
    assert len(got) == len(rows)
    of = {r[0]: r[2:] for r in got}
    assert of[0] == of[1] == of[2] == of[9] == (None, 0, "")
    assert of[3] == of[4] == of[None] == ("MIT", 1, "MIT") and of[5] == ("MIT", 0, "")
    assert of[6] == (None, 3, "Apache-2.0,MIT") and of[7] == (None, 0, "") and of[8] == (None, 1, "CC-BY-NC-4.0")
    other = spark.createDataFrame([("Mine", "not  released, under the MIT licence"), ("Void", None)], "license_id string, text string")
    assert {r.doc_id: r.license_id for r in L.scan(docs, other).collect()}[7] == "Mine"
    assert L.scan(docs.limit(0)).count() == 0


def test_complete_license_texts(spark):
    """Whole licences, wrapped anew, commented out, with typographic quotes and with copyright lines, are known; changed ones aren't."""
    rows, want = [], []
    for name, titles, body in license_texts.SHORT:
        curly = body.replace('"', "\u201c").replace("'", "\u2019").upper()
        wrapped = "\n".join(textwrap.fill(p, 50) for p in body.split("\n"))
        commented = "".join(f" * {line}\n" for line in f"{titles[0]}\n\nCopyright (c) 2020-2023 Some Body\nCopyright 2019 Else\nAll rights reserved.\n\n{wrapped}".split("\n"))
        for text in (body, curly, wrapped, f"/*\n{commented}*/", f"{titles[-1]}\r\n\r\n\u00a9 2001 A. Person\r\n(c) Jane Q. Public\r\n" + wrapped.replace("\n", "\r\n"), "\n".join(f"# {x}" for x in f"Copyright <YEAR> <OWNER>\n{body}".split("\n"))):
            rows.append((len(rows), text))
            want.append(name)
        rows.append((len(rows), body.replace("software", "hardware", 1).replace("SOFTWARE", "HARDWARE", 1).replace("You just", "You")))
        want.append(None)
    got = {r.doc_id: r.license_id for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_items_are_no_copyright_lines(spark):
    texts = ["first\n(c) You must retain all notices\nlast", "first\nlast", "first\n(c) 2020 Them\nlast", "first\n// Copyright: Some Body\nlast", "first\ncopyright holders be liable\nlast", "first\n% copyright (C) 1999 x y z\nlast"]
    form = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(L.canonical(F.col("text")).alias("x"))
    got = [r.x.split() for r in form.collect()]
    assert "retain" in got[0] and got[1] == got[2] == got[3] == got[5] == ["first", "last"] and "liable" in got[4]


PLACE = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(PLACE), reason="the public texts aren't on this machine")
def test_long_texts_by_digest(spark):
    rows = [(i, name, open(f"{PLACE}/{name}", encoding="utf-8").read()) for i, name, _ in license_texts.LONG if os.path.isfile(f"{PLACE}/{name}")]
    docs = spark.createDataFrame([(k, "\n".join("; " + x for x in t.split("\n"))) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in L.scan(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [i for i, _, _ in rows] and len(license_texts.LONG) >= 10


HTML = """<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><a href="/x">link</a><p>One  two<br>three</p><p>caf&eacute;</p></body></html>"""


def test_rows(spark):
    rows = [(1, "http://a.example/1", HTML), (2, None, None), (3, "http://b.example", ""), (3, "http://b.example", ""), (None, "u", "<p>" + "long " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record", "2 AS record_type")
    made = W.responses(pages)
    got = W.derivatives(made, key="page_id").collect()
    assert len(got) == 2 * len(rows)
    by = {(r.page_id, r.record_type): r for r in got}
    text, about = by[1, "conversion"], by[1, "metadata"]
    assert text.block == "link\nOne two\nthree\ncafé" and text.refers_to == about.refers_to == text.source_id
    assert "title: A & B\r\n" in about.block and "language: de\r\n" in about.block and "outlink: /x\r\n" in about.block and "http-status: HTTP/1.1 200 OK" in about.block
    assert by[2, "conversion"].block == "" and len(by[None, "conversion"].block) > 200_000
    # What is written can be read: digests, links and lengths agree.
    sources = [bytes(r.record) for r in made.collect()]
    for s in sources:
        headers, http, body = W.parsed(s)
        assert headers["warc-payload-digest"] == W.sha1(body) and int(http["content-length"]) == len(body)
    whole = b"".join(bytes(r.record) for r in got)
    again = list(W.records_of(gzip.compress(whole)))
    assert again == [bytes(r.record) for r in got]
    for r, data in zip(got, again):
        _, h = W.headers_of(data.partition(b"\r\n\r\n")[0])
        assert h["warc-refers-to"] == r.refers_to and h["warc-block-digest"] == r.block_digest == W.sha1(r.block.encode())
        assert h["warc-source-payload-digest"] == r.source_payload_digest
    files = spark.createDataFrame([(b"".join(sources),)], "content binary")
    assert W.split_files(files).count() == len(rows)
    assert W.derivatives(made.limit(0)).count() == 0


def test_unreadable(spark):
    good = W.response("u", HTML, "<urn:x>")
    chunked = W.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>")], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + b"%x\r\n" % len(z := gzip.compress(b"<p>hello")) + z + b"\r\n0\r\n\r\n")
    bad = [None, b"", b"junk", good[:200], good.replace(b"response", b"request!"), good.replace(b"HTTP/1.1", b"SMTP/1.1"), chunked]
    got = W.derivatives(spark.createDataFrame([(x,) for x in bad], "record binary")).collect()
    assert [bool(r.error) for r in got] == [True] * 6 + [False] * 2 and got[-1].block == "hello"


def answer(head: bytes, body: bytes) -> bytes:
    return W.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)


def test_sizes_and_encodings_that_lie():
    chunked, error = b"Transfer-Encoding: chunked", lambda data: W.derived(data)[0]["error"]
    for body in (b"-6\r\nabc\r\n", b"+3\r\nabc\r\n0\r\n\r\n", b"0x3\r\nabc\r\n0\r\n\r\n", b"\r\n", b"zz\r\n", b"ff\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert error(answer(chunked, body)), body
    assert W.derived(answer(chunked, b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"))[1]["block"] == "abcde"
    good = answer(b"X: y", b"<p>hi")
    size = good.split(b"Content-Length: ")[1].split(b"\r\n")[0]
    for lie in ("\u00b2".encode(), b"-1", b"1e3", b"", b"9" * 400, b" "):
        assert error(good.replace(b"Content-Length: " + size, b"Content-Length: " + lie))
    assert "encoding, br" in error(answer(b"Content-Encoding: br", b"\x8b\x02\x80"))
    packed = gzip.compress(b"<p>twice")
    assert W.derived(answer(b"Content-Encoding: gzip, identity\r\nContent-Encoding: gzip", gzip.compress(packed)))[1]["block"] == "twice"
    import zlib

    for data in (zlib.compress(b"<p>flat"), zlib.compress(b"<p>flat")[2:-4]):
        assert W.derived(answer(b"Content-Encoding: deflate", data))[1]["block"] == "flat"


def test_broken_files_give_their_records_and_an_error(spark):
    one = answer(b"X: y", b"<p>hi")
    cases = {"whole": (one * 3, 3, False), "cut": ((one * 3)[:-20], 2, True), "junk": (b"junk" * 9, 0, True), "zipped": (gzip.compress(one) * 3, 3, False), "zip cut": ((gzip.compress(one) * 3)[:-60], 2, True), "zip junk": (b"\x1f\x8bjunk", 0, True), "empty": (b"", 0, False), "null": (None, 0, False), "size": (one.replace(b"Content-Length: ", b"Content-Length: \xc2\xb2"), 0, True)}
    for name, (data, n, bad) in cases.items():
        got = W.split_files(spark.createDataFrame([(None if data is None else bytearray(data),)], "content binary")).collect()
        assert ([r.error for r in got].count(None), any(r.error for r in got)) == (n, bad), name
    files = spark.createDataFrame([(None if d is None else bytearray(d),) for d, _, _ in cases.values()], "content binary")
    assert W.split_files(files).count() == sum(n + bad for _, n, bad in cases.values())


def test_all_source_headers_are_kept():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nLink: <x>;\r\n rel=y\r\nSet-Cookie: b=2\r\nX-Empty:\r\nVia: p\r\nVia: q\r\n\r\n<p>hello"
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:z>"), ("WARC-Concurrent-To", "<urn:1>"), ("WARC-Concurrent-To", "<urn:2>"), ("WARC-IP-Address", "192.0.2.7"), ("WARC-Block-Digest", W.sha1(http))]
    block = W.derived(W.record(head, http))[0]["block"]
    lines = block.split("\r\n")
    assert [x for x in lines if x.startswith("http-")] == ["http-status: HTTP/1.1 200 OK", "http-set-cookie: a=1", "http-link: <x>; rel=y", "http-set-cookie: b=2", "http-x-empty: ", "http-via: p", "http-via: q"]
    assert [x for x in lines if x.startswith("source-warc-")] == [f"source-{k.lower()}: {v}" for k, v in head]
