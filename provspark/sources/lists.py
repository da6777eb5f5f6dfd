"""Lists that trust and policy read: revocation statements, revoked signers, keys, roles, and certificate revocation lists.

Sources that can't be read must not look empty. load_* functions are strict and raise; statements() is tolerant, and
tells what was wrong, so a report can withhold VALID.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT = "artifact_digest string, signer string, issued_ms long, reason string, signature binary"


class Unreadable(ValueError):
    """A list that is absent, or of a wrong shape."""


def statement_of(entry: Any) -> tuple | None:
    """A statement's fields, or None if it is malformed."""
    if not isinstance(entry, dict):
        return None
    row = tuple(entry.get(k) for k in ("artifact_digest", "signer", "issued_ms", "reason", "signature"))
    if not all(isinstance(row[k], str) for k in (0, 1, 3, 4)) or not isinstance(row[2], int) or isinstance(row[2], bool) or not 0 <= row[2] < 1 << 63:
        return None
    try:
        return *row[:4], base64.b64decode(row[4], validate=True)
    except (binascii.Error, ValueError):
        return None


def parsed_statements(text: str | None) -> tuple[list[tuple], int, str]:
    """Statements, the number of malformed ones, and an error for the whole ('' if none)."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return [], 0, "unreadable"
    entries = data.get("revocations") if isinstance(data, dict) else None
    if not isinstance(entries, list):
        return [], 0, "malformed"
    got = [statement_of(e) for e in entries]
    return [s for s in got if s], sum(s is None for s in got), ""


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, by any store that Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def statements(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (path, text): statement rows, and (path, n_good, n_malformed, error) by file."""
    kind = pa.schema([("path", pa.string()), ("n_good", pa.int64()), ("n_malformed", pa.int64()), ("error", pa.string()), ("rows", pa.list_(pa.struct([("artifact_digest", pa.string()), ("signer", pa.string()), ("issued_ms", pa.int64()), ("reason", pa.string()), ("signature", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("artifact_digest", "signer", "issued_ms", "reason", "signature")
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                good, bad, error = parsed_statements(text)
                out.append({"path": path, "n_good": len(good), "n_malformed": bad, "error": error, "rows": [dict(zip(names, s)) for s in good]})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    read = texts.select("path", "text").mapInArrow(run, f"path string, n_good long, n_malformed long, error string, rows array<struct<{STATEMENT}>>")
    return read.select(F.explode("rows").alias("r")).select("r.*"), read.drop("rows")


def load_statements(spark: SparkSession, path: str) -> DataFrame:
    """All statements of files; any error raises."""
    rows, state = statements(files(spark, path))
    bad = state.filter("error <> '' OR n_malformed > 0").select("path").head()
    if bad:
        raise Unreadable(f"{bad[0]} is malformed")
    return rows


def save_statements(rows: DataFrame, path: str) -> None:
    """One JSON list for each partition, which load_statements() reads."""
    fields = ["artifact_digest", "signer", "issued_ms", "reason", F.base64("signature").alias("signature")]
    rows.groupBy(F.spark_partition_id().alias("_p")).agg(F.to_json(F.struct(F.collect_list(F.struct(*fields)).alias("revocations"))).alias("value")).select("value").write.text(path)


def whole(spark: SparkSession, path: str) -> Any:
    """One small JSON file."""
    row = files(spark, path).select("text").head()
    try:
        return json.loads(row[0] if row else "")
    except ValueError as e:
        raise Unreadable(f"{path} is unreadable") from e


def load_signers(spark: SparkSession, path: str) -> DataFrame:
    """(signer) of {"revoked": [...]}."""
    data = whole(spark, path)
    names = data.get("revoked", []) if isinstance(data, dict) else None
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise Unreadable(f"{path} isn't a list of signers")
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "signer string")


def load_revoked_keys(spark: SparkSession, path: str) -> DataFrame:
    """(signer, revoked_ms) of {"revoked": {signer: time}}."""
    data = whole(spark, path)
    times = data.get("revoked", {}) if isinstance(data, dict) else None
    if not isinstance(times, dict) or not all(isinstance(t, int) and not isinstance(t, bool) for t in times.values()):
        raise Unreadable(f"{path} isn't a map of signers to times")
    return spark.createDataFrame(list(times.items()), "signer string, revoked_ms long")


def load_roles(spark: SparkSession, path: str) -> DataFrame:
    """(role, signer) of {"roles": {role: [signers]}}. A role without signers has a row with none, so it is open to nobody."""
    data = whole(spark, path)
    roles = data.get("roles", {}) if isinstance(data, dict) else None
    if not isinstance(roles, dict) or not all(isinstance(s, list) and all(isinstance(x, str) for x in s) for s in roles.values()):
        raise Unreadable(f"{path} isn't a map of roles to signers")
    return spark.createDataFrame([(r, s) for r, names in roles.items() for s in names or [None]], "role string, signer string")


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    """(signer, key_b64) of files whose names are percent-encoded signers with the ending .pub, and whose bytes are raw keys."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pub").load(path)
    # The name is taken from the path, which Spark has encoded itself.
    name = F.regexp_extract("path", r"([^/]*)\.pub$", 1)
    return rows.select(F.call_function("url_decode", name).alias("signer"), F.base64("content").alias("key_b64"))


def successors(log: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """by, signer and successor: the last key that follows a signer's, through records that both keys signed.

    log: by, old_signer, superseded_by, timestamp_ms, proof, new_key_proof; known: (signer, key_b64). Proofs are checked where records
    are; a log is then walked by one task, a record at most for each key. A ring ends where it began. Of records for one key the latest counts.
    """
    from provspark.codec import ed25519, keys

    k = known.select("signer", "key_b64").dropDuplicates(["signer"])
    met = log.join(k.select(F.col("signer").alias("old_signer"), F.col("key_b64").alias("_old")), "old_signer").join(k.select(F.col("signer").alias("superseded_by"), F.col("key_b64").alias("_new")), "superseded_by")
    kind = log.schema[by].dataType.simpleString()

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [bool((old := ed25519.raw_key(r["_old"])) and (new := ed25519.raw_key(r["_new"])) and keys.rotation_ok(r, old, new)) for r in b.to_pylist()]
            yield b.select([by, "old_signer", "superseded_by", "timestamp_ms"]).filter(pa.array(ok, pa.bool_()))

    checked = met.select(by, "old_signer", "superseded_by", "timestamp_ms", "proof", "new_key_proof", "_old", "_new").mapInArrow(good, f"{by} {kind}, old_signer string, superseded_by string, timestamp_ms long")
    last = checked.groupBy(by, "old_signer").agg(F.max(F.struct("timestamp_ms", "superseded_by"))["superseded_by"].alias("superseded_by"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(own, steps: dict[str, str]) -> pa.RecordBatch:
            out = []
            for start in steps:
                seen, at = {start}, steps[start]
                while at in steps and at not in seen:
                    seen.add(at)
                    at = steps[at]
                out.append((own, start, at))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[by, "signer", "successor"])

        own, steps, types = None, {}, []
        for b in batches:
            types = [b.schema.field(by).type, pa.string(), pa.string()]
            for r in b.to_pylist():
                if r[by] != own and steps:
                    yield told(own, steps)
                    steps = {}
                own = r[by]
                steps[r["old_signer"]] = r["superseded_by"]
        if steps:
            yield told(own, steps)

    return last.repartition(by).sortWithinPartitions(by).mapInArrow(walk, f"{by} {kind}, signer string, successor string")


def revoked_names(text: str) -> list[str]:
    """Names of a revocation list in any of its spellings: an object with "revoked", any object, an array, or lines."""
    try:
        data = json.loads(text)
    except ValueError:
        lines = (x for x in text.splitlines() if not x.startswith("#"))
        return [x.strip() for x in lines if x.strip()]
    if isinstance(data, dict):
        return list(data["revoked"] if isinstance(data.get("revoked"), dict) else data)
    return [str(x) for x in data] if isinstance(data, list) else []


class Crl:
    """A revocation list that is read again after ttl seconds, as in foreachBatch. The first failure raises; later ones keep the last list."""

    def __init__(self, read, ttl: float = 300, clock=None) -> None:
        import time

        self.read, self.ttl, self.clock = read, ttl, clock or time.monotonic
        self.names: list[str] | None = None
        self.at = 0.0

    def current(self) -> list[str]:
        if self.names is None or self.clock() - self.at >= self.ttl:
            try:
                self.names = revoked_names(self.read())
                self.at = self.clock()
            except Exception as e:
                if self.names is None:
                    raise Unreadable("the revocation list can't be read") from e
        return self.names

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n,) for n in self.current()], "signer string")
