"""A sink that writes one file for each row, and the registration of functions for SQL."""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from provspark.codec import artifact as A
from provspark.codec import cbor, ed25519
from provspark.codec.stream import events_of
from provspark.operators.graph import in_row_stuck


def file_name(key: str) -> str:
    """A key as a file name: all but letters, digits and -_. percent-encoded."""
    return urllib.parse.quote(key, safe="-_.")


@dataclass
class Written(WriterCommitMessage):
    names: list


class FilesWriter(DataSourceWriter):
    """Tasks write under names of their own; commit() gives files their names, so a task that runs twice leaves one."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        names = []
        for row in rows:
            final = file_name(row[0])
            temporary = f".{uuid.uuid4().hex}"
            with open(os.path.join(self.path, temporary), "wb") as f:
                f.write(row[1] or b"")
            names.append((temporary, final))
        return Written(names)

    def commit(self, messages: list) -> None:
        for m in messages:
            for temporary, final in m.names if m else ():
                os.replace(os.path.join(self.path, temporary), os.path.join(self.path, final))

    def abort(self, messages: list) -> None:
        for m in messages:
            for temporary, _ in m.names if m else ():
                if os.path.exists(os.path.join(self.path, temporary)):
                    os.remove(os.path.join(self.path, temporary))


class ArtifactFiles(DataSource):
    """df.write.format("artifact_files").option("path", ...): columns are a name and bytes. The folder is one that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


class Chunks:
    """Table function artifact_chunks(bytes)."""

    def eval(self, data: bytes):
        for no, c in enumerate(A.listing(bytes(data or b""))):
            yield no, c["type"], c["name"], c["offset"], c["length"]


class Nodes:
    """Table function artifact_nodes(bytes); nothing for what can't be decoded."""

    def eval(self, data: bytes):
        try:
            doc = A.decode(bytes(data or b""))
        except A.Invalid:
            return
        for pos, n in enumerate(doc["payload"]):
            yield pos, n["id"], n["type"], A.text_of(n["value"]), float(n["confidence"]["mean"]), n["refs"]


class Events:
    """Table function stream_events(bytes)."""

    def eval(self, data: bytes):
        for no, e in enumerate(events_of(bytes(data or b""))):
            yield no, e["event"], e.get("node_id"), e.get("seq"), e.get("text"), e.get("error")


def decode_error(data: bytes) -> tuple[str, int]:
    try:
        A.decode(data)
    except A.Invalid as e:
        return e.kind, e.stage
    return "", 0


def form_of(data: bytes) -> str:
    """malformed, lax, unsorted or deterministic."""
    try:
        _, form = cbor.decode(data)
    except cbor.Malformed:
        return "malformed"
    return "lax" if form.strict else "unsorted" if form.deterministic else "deterministic"


def content_id_of(data: bytes) -> str | None:
    try:
        return A.content_id(A.decode(data))
    except A.Invalid:
        return None


def vectorized(f, kind: str):
    """A function of columns as an Arrow-batched UDF; a null argument gives null."""
    import pandas as pd

    # Annotations are given by hand, as they can't be read from strings.
    def run(*columns):
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns)])

    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)


def register(spark: SparkSession) -> None:
    """Register the sink and all SQL functions with a session."""
    spark.dataSource.register(ArtifactFiles)
    tables = {"artifact_chunks": (Chunks, "chunk_no int, type int, name string, offset long, length long"), "artifact_nodes": (Nodes, "pos int, id string, type string, value string, mean double, refs array<string>"), "stream_events": (Events, "event_no int, event string, node_id string, seq long, text string, error string")}
    for name, (cls, kind) in tables.items():
        spark.udtf.register(name, F.udtf(type(cls.__name__, (cls,), {}), returnType=kind))
    scalars = {
        "artifact_digest": (lambda d: A.digest(bytes(d)), "string"),
        "artifact_error": (lambda d: decode_error(bytes(d))[0], "string"),
        "content_id": (lambda d: content_id_of(bytes(d)), "string"),
        "cbor_form": (lambda d: form_of(bytes(d)), "string"),
        "cbor_json": (lambda d: A.text_of(cbor.decode(bytes(d))[0]), "string"),
        "ed25519_verify": (lambda k, m, s: ed25519.verify(bytes(k), bytes(m), bytes(s)), "boolean"),
        "dag_status": (lambda ids, deps: "cycle" if in_row_stuck(list(ids), [list(d) for d in deps]) else "ok", "string"),
    }
    for name, (f, kind) in scalars.items():
        spark.udf.register(name, vectorized(f, kind))
