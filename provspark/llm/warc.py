"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Each response record gives two records that refer to it: metadata (all headers of the source record and of its HTTP
message, in order and with repeated ones, the page's title, language and links) and conversion (its text). Both keep the source's date, target and payload
digest, and each has a block digest of its own. Record identifiers are name-based, so a page that
is derived again gets the same ones.

Defined results: a null or empty page gives both records with an empty text; a null url an empty target; a
record that isn't a response, or can't be read (a size that is no number, a bad or cut chunk, a body in an encoding
other than gzip, deflate and zstd), gives one row with an error and nothing else; repeated rows repeat; very long pages are
handled whole, one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import batch, map_batches

DATE, VERSION = "2024-01-01T00:00:00Z", b"WARC/1.1"
NEWLINE = b"\r\n"
SKIPPED = frozenset(("script", "style", "noscript", "template"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
ROWS = pa.schema([(n, pa.string()) for n in ("source_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_payload_digest", "block_digest", "block", "error")] + [("record", pa.binary())])
SPARK_ROWS = ", ".join(f"{n} string" for n in ROWS.names[:-1]) + ", record binary"


class Unreadable(ValueError):
    """Not a WARC response with an HTTP message."""


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; Content-Length is added. Line breaks in values become blanks."""
    lines = [f"{k}: {' '.join(v.splitlines())}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return NEWLINE.join([VERSION, *lines, b"", block, b"", b""])


class Headers(dict[str, str]):
    """The last value of each header by lower-case name, and all of them in order, with repeated ones, as pairs."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        super().__init__(pairs)
        self.pairs = pairs


def headers_of(head: bytes) -> tuple[str, Headers]:
    """A first line and the headers below it; a line that begins with a blank goes on."""
    first, *rest = head.split(NEWLINE)
    out: list[tuple[str, str]] = []
    for line in rest:
        text = line.decode("utf-8", "replace")
        if out and text[:1] in (" ", "\t"):
            out[-1] = out[-1][0], out[-1][1] + " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return first.decode("utf-8", "replace"), Headers(out)


NUMBER, HEX = re.compile(r"[0-9]{1,18}"), re.compile(rb"[0-9A-Fa-f]{1,15}")


def size_of(headers: Headers) -> int:
    if not NUMBER.fullmatch(size := headers.get("content-length", "")):
        raise Unreadable("no content length")
    return int(size)


def inflated(data: bytes) -> tuple[bytes, str]:
    """A file's bytes, and an error if it is gzipped (as a whole or by record) and broken after them."""
    if data[:2] != b"\x1f\x8b":
        return data, ""
    out, error = [], ""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            while part := f.read1(1 << 20):
                out.append(part)
    except (OSError, EOFError, zlib.error):
        error = "the file can't be decompressed to its end"
    return b"".join(out), error


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or gzipped, each with the blank lines that end it. What can't be read raises after the records before it."""
    data, error = inflated(data)
    at = 0
    while at < len(data):
        gap = data.find(NEWLINE * 2, at)
        if gap < 0:
            if data[at:].strip():
                raise Unreadable(error or "the last record is cut short")
            break
        first, headers = headers_of(data[at:gap])
        if not first.startswith("WARC/"):
            raise Unreadable("not a WARC record")
        end = gap + 4 + size_of(headers)
        if end > len(data):
            raise Unreadable(error or "the last record is cut short")
        yield data[at : end + 4]
        at = end + 4
    if error:
        raise Unreadable(error)


def parsed(data: bytes) -> tuple[Headers, Headers, bytes]:
    """A response record's own headers, its HTTP headers (the status line as ':status') and its body, decoded."""
    head, gap, rest = data.partition(NEWLINE * 2)
    first, headers = headers_of(head)
    if not gap or not first.startswith("WARC/"):
        raise Unreadable("not a WARC record")
    if headers.get("warc-type") != "response":
        raise Unreadable("not a response")
    if (size := size_of(headers)) > len(rest):
        raise Unreadable("cut short")
    message, gap, body = rest[:size].partition(NEWLINE * 2)
    status, http = headers_of(message)
    if not gap or not status.startswith("HTTP/"):
        raise Unreadable("no HTTP message")
    codings = [c.strip() for n in ("content-encoding", "transfer-encoding") for k, v in http.pairs if k == n for c in v.lower().split(",")]
    for c in reversed([c for c in codings if c not in ("", "identity")]):
        body = uncoded(body, c)
    return headers, Headers([(":status", status), *http.pairs]), body


def uncoded(body: bytes, coding: str) -> bytes:
    try:
        if coding == "chunked":
            return unchunked(body)
        if coding in ("gzip", "x-gzip"):
            return zlib.decompress(body, 31)
        if coding == "deflate":  # by the standard with a zlib head, by some servers without one
            return zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2], "big") % 31 == 0 else -15)
        if coding == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except (zlib.error, zstandard.ZstdError) as e:
        raise Unreadable("the body can't be decompressed") from e
    raise Unreadable(f"the body is in an unknown encoding, {coding}")


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(NEWLINE, at)) >= 0:
        if not HEX.fullmatch(size := body[at:end].partition(b";")[0].strip()):
            raise Unreadable("a bad chunk")
        n, begin = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if begin + n > len(body):
            break
        out.append(body[begin : begin + n])
        at = begin + n + 2
    raise Unreadable("chunks are cut short")


class Page(HTMLParser):
    """Text, title, language and links of a page. Blocks begin new lines; runs of white space are one blank."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title, self.lang, self.hidden, self.in_title = "", "", "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in SKIPPED:
            self.hidden = self.hidden or tag
        if tag == "html":
            self.lang = given.get("lang") or ""
        if tag == "a" and given.get("href"):
            self.links.append(given["href"])
        self.in_title = tag == "title" or self.in_title
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == self.hidden:
            self.hidden = ""
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.in_title:
            self.title += data
        else:
            self.parts.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def page_of(http: dict[str, str], body: bytes) -> Page:
    kind = http.get("content-type", "text/html").lower()
    charset = kind.partition("charset=")[2].partition(";")[0].strip(" \"'") or "utf-8"
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    page = Page()
    if "html" in kind:
        page.feed(text)
        page.close()
    else:
        page.parts.append(text)
    return page


def name_of(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def derived(data: bytes) -> list[dict]:
    """The rows of ROWS for one record: metadata and conversion, or one with an error."""
    try:
        headers, http, body = parsed(data or b"")
        source = headers.get("warc-record-id", "")
        if not source:
            raise Unreadable("no record id")
    except Unreadable as e:
        return [dict.fromkeys(ROWS.names) | {"error": str(e)}]
    page, digest = page_of(http, body), headers.get("warc-payload-digest") or sha1(body)
    fields = [("title", page.title.strip()), ("language", page.lang), ("source-digest", digest)]
    fields = [x for x in fields if x[1]] + [(f"source-{k}", v) for k, v in headers.pairs]
    fields += [(f"http-{k.lstrip(':')}", v) for k, v in http.pairs] + [("outlink", x) for x in page.links]
    metadata = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", page.text().encode("utf-8", "replace"))):
        own = {"record_type": kind, "record_id": name_of(source, kind), "refers_to": source, "target_uri": headers.get("warc-target-uri", ""), "date": headers.get("warc-date", ""), "content_type": content, "source_payload_digest": digest, "block_digest": sha1(block)}
        head = [("WARC-Type", kind), ("WARC-Record-ID", own["record_id"]), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", own["target_uri"]), ("WARC-Refers-To-Date", own["date"])]
        head += [("WARC-Target-URI", own["target_uri"]), ("WARC-Date", own["date"]), ("WARC-Source-Payload-Digest", digest), ("WARC-Block-Digest", own["block_digest"]), ("Content-Type", content)]
        out.append(own | {"source_id": source, "block": block.decode(), "error": None, "record": record(head, block)})
    return out


def response(url: str, html: str, name: str, date: str = DATE) -> bytes:
    """A response record for a page."""
    body = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http)), ("Content-Type", "application/http; msgtype=response")]
    return record(head, http)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and record, a response, for pages (page_id, url, html)."""
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids, urls, texts = (rows.column(n).to_pylist() for n in ("page_id", "url", "html"))
            made = [response(u or "", t or "", name_of(f"{i} {u or ''}", "response"), date) for i, u, t in zip(ids, urls, texts)]
            return batch(schema, page_id=ids, record=made)

        return f

    columns = [F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return map_batches(pages.select(*columns), ["page_id", "url", "html"], make, "page_id long, record binary")


def split_files(files: DataFrame, column: str = "content") -> DataFrame:
    """record and error, one row for each record of whole WARC files, as from the binaryFile source, which takes files of up to 2 GB.

    A file that can't be read to its end gives its records up to there, and a row with the error and no record.
    """
    schema = pa.schema([("record", pa.binary()), ("error", pa.string())])

    def rows_of(data: bytes | None) -> Iterator[tuple[bytes | None, str | None]]:
        try:
            for r in records_of(data or b""):
                yield r, None
        except Unreadable as e:
            yield None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                made, size = [], 0
                for r, error in rows_of(data.as_py()):
                    made.append((r, error))
                    size += len(r or b"")
                    if size > 8 << 20:
                        yield batch(schema, record=[x for x, _ in made], error=[x for _, x in made])
                        made, size = [], 0
                yield batch(schema, record=[x for x, _ in made], error=[x for _, x in made])

    return files.select(F.col(column).cast("binary").alias("content")).mapInArrow(run, "record binary, error string")


def derivatives(records: DataFrame, column: str = "record", key: str | None = None) -> DataFrame:
    """The derived records of a column of records; key, if given, is an integer column that is kept."""
    schema = pa.schema([*([(key, pa.int64())] if key else []), *ROWS])

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            keys = rows.column(1).to_pylist() if key else [None] * rows.num_rows
            made = [(k, x) for k, data in zip(keys, rows.column(0).to_pylist()) for x in derived(data)]
            columns = {n: [x[n] for _, x in made] for n in ROWS.names}
            return batch(schema, **columns, **({key: [k for k, _ in made]} if key else {}))

        return f

    chosen = [F.col(column).cast("binary").alias("record"), *([F.col(key).cast("bigint").alias(key)] if key else [])]
    return map_batches(records.select(*chosen), ["record", *([key] if key else [])], make, (f"{key} long, " if key else "") + SPARK_ROWS)
