"""Artifacts as tables: from files or a column of bytes to nested rows, and back.

Bytes cross to Python once, in Arrow batches; all that follows are columns. A row that can't be decoded keeps its
place, with the failure in the column decode, so nothing throws and precedence can be told.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.codec import artifact as A
from provspark.codec import cbor, ed25519, layouts
from provspark.functions.scalars import HYBRID_KEY, HYBRID_SIGNATURE, PQ_SIGNATURE, is_cross
from provspark.operators.shared import cut
from provspark.sources import governance

DIST = pa.struct([("mean", pa.float64()), ("var", pa.float64()), ("shape", pa.string()), ("semantics", pa.string()), ("p5", pa.float64()), ("p95", pa.float64())])
NODE = pa.struct([("id", pa.string()), ("type", pa.string()), ("value", pa.string()), ("value_cbor", pa.binary()), ("value_kind", pa.string()), ("confidence", DIST), ("refs", pa.list_(pa.string()))])
STEP = pa.struct([("id", pa.string()), ("type", pa.string()), ("value", pa.string()), ("value_cbor", pa.binary()), ("value_kind", pa.string()), ("confidence", DIST), ("deps", pa.list_(pa.string())), ("alternatives", pa.list_(pa.string()))])
SIGNATURE = pa.struct([("slot", pa.string()), ("algorithm", pa.string()), ("signer", pa.string()), ("signature", pa.binary()), ("key_id", pa.string())])
STATEMENT = pa.struct([("artifact_digest", pa.string()), ("signer", pa.string()), ("issued_ms", pa.int64()), ("reason", pa.string()), ("signature", pa.binary())])
TYPES = {str: pa.string(), int: pa.int64(), float: pa.float64()}
plain = lambda defaults: pa.struct([(k, TYPES[type(v)]) for k, v in defaults.items()])
ROW = pa.schema([
    ("artifact_id", pa.string()), ("decode", pa.struct([("ok", pa.bool_()), ("error_class", pa.string()), ("error_stage", pa.int32()), ("error", pa.string())])),
    ("wire_version", pa.int32()), ("flags", pa.int32()), ("flags2", pa.int32()), ("created_ms", pa.int64()), ("artifact_digest", pa.string()), ("content_id", pa.string()), ("body", pa.binary()),
    ("provenance", plain(A.PROVENANCE)), ("task", plain(A.TASK)),
    ("semantic", pa.struct([("embedding_model", pa.string()), ("dim", pa.int32()), ("embedding", pa.list_(pa.float64())), ("covariance", pa.list_(pa.list_(pa.float64())))])),
    ("trace_method", pa.string()), ("trace", pa.list_(STEP)), ("payload", pa.list_(NODE)), ("normalized", pa.bool_()), ("alternatives", pa.list_(pa.struct([("weight", pa.float64()), ("nodes", pa.list_(NODE))]))),
    ("delta", pa.struct([("base_hash", pa.string()), ("changes", pa.list_(pa.string()))])), ("signer_roles", pa.list_(pa.struct([("signer", pa.string()), ("role", pa.string())]))),
    ("signatures", pa.list_(SIGNATURE)), ("revocations", pa.list_(STATEMENT)), ("timestamp_anchor", pa.struct([("authority", pa.string()), ("time_ms", pa.int64()), ("token", pa.binary())])),
])
CHECKED = pa.struct([("signer", pa.string()), ("algorithm", pa.string()), ("status", pa.string()), ("basis", pa.string())])
#: What reports need of an artifact; body only where keys are joined.
ASSESSED = pa.schema([*(ROW.field(n) for n in ("artifact_id", "decode", "artifact_digest", "content_id", "provenance", "signatures", "revocations", "timestamp_anchor", "body")), ("refs", pa.list_(pa.string())), ("checked", pa.list_(CHECKED)), ("confidence", pa.float64()), ("event", governance.EVENT), ("roles", ROW.field("signer_roles").type)])
LONG = (1 << 63) - 1
#: Pinned keys up to which every worker holds all of them.
HELD_KEYS = 100_000


def valued(x: dict) -> dict:
    return x | {"value": A.text_of(x["value"]), "value_cbor": cbor.encode(x["value"]), "value_kind": A.kind_of(x["value"]), "alternatives": [A.text_of(a) for a in x.get("alternatives", [])]}


def row_of(artifact_id: str, data: bytes | None, with_body: bool) -> dict:
    """One row of ROW. Integers beyond 64 bits count as a format error of the columns."""
    data = data or b""
    base = {"artifact_id": artifact_id, "artifact_digest": A.digest(data), "body": A.signing_body(data) if with_body else None}
    try:
        doc = A.decode(data)
        if doc["provenance"] and max(doc["provenance"]["timestamp_ms"], doc["provenance"]["attempt"]) > LONG:
            raise A.Invalid("format", 11, "PROVENANCE has a number beyond 64 bits")
    except A.Invalid as e:
        return base | {"decode": {"ok": False, "error_class": e.kind, "error_stage": e.stage, "error": str(e)}}
    base |= {"content_id": A.content_id(doc), "decode": {"ok": True, "error_class": "", "error_stage": 0, "error": ""}}
    base["event"] = governance.event_of(doc)
    doc["payload"], doc["trace"] = [*map(valued, doc["payload"])], [*map(valued, doc["trace"])]
    doc["alternatives"] = [a | {"nodes": [*map(valued, a["nodes"])]} for a in doc["alternatives"]]
    doc["signer_roles"] = [{"signer": k, "role": v} for k, v in doc["signer_roles"].items()]
    if doc["delta"]:
        doc["delta"]["changes"] = [A.text_of(c) for c in doc["delta"]["changes"]]
    return base | doc


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def decoded(files: DataFrame, key: str = "path", content: str = "content", with_body: bool = False) -> DataFrame:
    """The rows of ROW for a table of bytes. with_body: with the signed bytes, which verified() needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row_of(k, d, with_body) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=ROW)

    return files.select(F.col(key).cast("string").alias("artifact_id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, spark_schema(ROW))


def read(spark: SparkSession, path: str, require_signature: bool = False, glob: str = "*") -> DataFrame:
    """Artifacts below a path, decoded. require_signature: unsigned ones become failures."""
    out = decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))
    if not require_signature:
        return out
    unsigned = F.col("decode.ok") & (F.size("signatures") <= 0)
    failure = F.struct(F.lit(False).alias("ok"), F.lit("signature").alias("error_class"), F.lit(13).alias("error_stage"), F.lit("a signature is required").alias("error"))
    return out.withColumn("decode", F.when(unsigned, failure).otherwise(F.col("decode")))


def chunk_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(artifact_id, chunk_no, type, name, offset, length, before_auth) of each chunk, of broken files too."""
    schema = pa.schema([("artifact_id", pa.string()), ("chunk_no", pa.int32()), ("type", pa.int32()), ("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("before_auth", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                auth = False
                for no, c in enumerate(A.listing(d or b"")):
                    auth = auth or c["name"] in ("SIGNATURE", "MULTISIG")
                    out.append({"artifact_id": k, "chunk_no": no, "before_auth": not auth, **c})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select(F.col(key).cast("string").alias("artifact_id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, spark_schema(schema))


def simple_documents(df: DataFrame, seeds: dict[str, bytes] | None = None, packing: str = "") -> DataFrame:
    """(artifact_id, content): artifacts from rows (artifact_id, nodes, provenance, signers).

    nodes: array of (id, type, value text, mean, refs); provenance: a struct of some of its fields; signers:
    array of ids, whose private seeds are in seeds (for fixtures only; a rejected one is left out).
    """
    schema = pa.schema([("artifact_id", pa.string()), ("content", pa.binary())])
    seeds = seeds or {}

    def build(r: dict) -> bytes:
        nodes = [{"id": n["id"], "type": n["type"], "value": n["value"], "confidence": {"mean": n["mean"], "var": 0.0, "shape": "point", "semantics": "epistemic"}, "refs": n["refs"] or []} for n in r["nodes"]]
        doc = {"payload": nodes, "provenance": {k: v for k, v in (r["provenance"] or {}).items() if v is not None} or None}
        signers = [(s, lambda m, k=seeds[s]: ed25519.sign(k, m)) for s in r["signers"] or [] if s in seeds]
        return A.signed(doc, signers, packing) if signers else A.encode(doc, packing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pylist([{"artifact_id": r["artifact_id"], "content": build(r)} for r in rows], schema=schema)

    return df.select(F.col("artifact_id").cast("string").alias("artifact_id"), "nodes", "provenance", "signers").mapInArrow(run, "artifact_id string, content binary")


def write_files(df: DataFrame, path: str, key: str = "artifact_id", content: str = "content") -> None:
    """One file for each row, below a path that all executors share, by Spark's own file system layer of the sink."""
    from pyspark.sql.datasource import DataSource  # noqa: F401  the sink is registered by register()

    df.select(F.col(key).cast("string").alias("name"), F.col(content).alias("content")).write.format("artifact_files").option("path", path).mode("append").save()


def verified(rows: DataFrame, known: DataFrame | None = None, require_pq: bool = False) -> DataFrame:
    """(artifact_id, signer, algorithm, status, basis) for each signature of decoded(..., with_body=True) rows.

    known: (signer, key_b64) of pinned keys. Signatures are checked where their bytes are: only keys are joined.
    require_pq: post-quantum components must be checked too, for which there is no backend here, so good ones are unverifiable.
    """
    one = rows.filter("decode.ok").select("artifact_id", "body", F.explode("signatures").alias("s")).select("artifact_id", "body", "s.signer", "s.algorithm", "s.signature")
    if known is not None:
        k = known.select(F.col("signer").alias("_s"), F.col("key_b64").alias("_k"))
        one = one.join(k, F.col("signer") == F.col("_s"), "left")
    else:
        one = one.withColumns({"_s": F.lit(None).cast("string"), "_k": F.lit(None).cast("string")})
    pinned = F.col("_s").isNotNull()
    one = one.select("artifact_id", "signer", "algorithm", F.when(pinned, F.col("_k")).otherwise(F.col("signer")).alias("key"), F.when(pinned, "pinned").otherwise("resolved").alias("basis"), "body", "signature")
    return one.mapInArrow(lambda batches: check_signatures(batches, require_pq), "artifact_id string, signer string, algorithm string, status string, basis string")


def check_signatures(batches: Iterator[pa.RecordBatch], require_pq: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string()) for n in ("artifact_id", "signer", "algorithm", "status", "basis")])
    for b in batches:
        out = []
        for r in b.to_pylist():
            out.append({k: r[k] for k in ("artifact_id", "signer", "algorithm", "basis")} | {"status": signature_status(r, require_pq)})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def signature_status(r: dict, require_pq: bool) -> str:
    """Of a signature with the key that its signer stands for, and the signed bytes."""
    if r["algorithm"] == "ed25519+ml-dsa-65":
        return hybrid_status(r, require_pq)
    if r["algorithm"] == "ml-dsa-65":
        return "invalid" if require_pq and len(r["signature"]) != PQ_SIGNATURE else "unverifiable"
    key = ed25519.raw_key(r["key"] or "")
    if r["algorithm"] != "ed25519" or key is None or ed25519.weak(key):
        return "unverifiable"
    return "valid" if ed25519.verify(key, r["body"], r["signature"]) else "invalid"


def hybrid_status(r: dict, require_pq: bool) -> str:
    """In classical mode the first component decides; a size that isn't the registered one is invalid in either mode."""
    if len(r["signature"]) != HYBRID_SIGNATURE:
        return "invalid"
    try:
        raw = base64.b64decode(r["key"] or "", validate=True)
    except (binascii.Error, ValueError):
        return "unverifiable"
    if len(raw) not in (32, HYBRID_KEY):
        return "unverifiable"
    if not ed25519.verify(raw[:32], r["body"], r["signature"][:64]):
        return "invalid"
    return "unverifiable" if require_pq else "valid"


#: Why an artifact is revoked.
REASONS = ("compromised", "retracted", "superseded", "other")


def revocations(files: DataFrame, seeds: dict[str, bytes], key: str = "artifact_id", content: str = "content") -> DataFrame:
    """Signed revocation statements for a table of bytes with signer, issued_ms and reason; seeds: private keys by signer. Others' signers get no row."""
    schema = pa.schema([STATEMENT.field(i) for i in range(STATEMENT.num_fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["signer"] not in seeds:
                    continue
                if r["reason"] not in REASONS:
                    raise ValueError(f"{r['reason']} is no reason")
                told = {"artifact_digest": A.digest(r["content"]), "signer": r["signer"], "issued_ms": r["issued_ms"], "reason": r["reason"]}
                out.append(told | {"signature": ed25519.sign(seeds[r["signer"]], A.statement_bytes(told))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    columns = [F.col(content).alias("content"), "signer", F.col("issued_ms").cast("bigint").alias("issued_ms"), "reason"]
    return files.select(*columns).mapInArrow(run, "artifact_digest string, signer string, issued_ms long, reason string, signature binary")


def timestamped(files: DataFrame, seeds: dict[str, bytes], key: str = "artifact_id", content: str = "content") -> DataFrame:
    """(artifact_id, content) with a time anchor attached by authority at time_ms, countersigned with the seed of the authority; a null authority attaches none."""
    schema = pa.schema([("artifact_id", pa.string()), ("content", pa.binary())])

    def anchor(r: dict) -> dict:
        token = ed25519.sign(seeds[r["authority"]], A.anchor_bytes(A.digest(r["content"]), r["time_ms"]))
        return {"authority": r["authority"], "time_ms": r["time_ms"], "token": token}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"artifact_id": r["artifact_id"], "content": r["content"] if r["authority"] is None else A.attached(r["content"], "TIMESTAMP", anchor(r))} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col(key).alias("artifact_id"), F.col(content).alias("content"), "authority", F.col("time_ms").cast("bigint").alias("time_ms")).mapInArrow(run, "artifact_id string, content binary")


def pinned_key(signer: str, held: dict[str, str]) -> tuple[str, str]:
    """The key that a signer id stands for, and on what basis: a pinned one wherever the id is known, usable or not; else the id itself."""
    return (held[signer], "pinned") if signer in held else (signer, "resolved")


def held_keys(known: DataFrame | None) -> dict[str, str] | None:
    """Pinned keys by signer for workers to hold, or None if there are more than HELD_KEYS of them."""
    if known is None:
        return {}
    rows = known.select("signer", "key_b64").dropDuplicates(["signer"]).limit(HELD_KEYS + 1).collect()  # counted, HELD_KEYS + 1 at most
    return {r.signer: r.key_b64 or "" for r in rows} if len(rows) <= HELD_KEYS else None


def assessed(files: DataFrame, key: str, content: str, known: DataFrame | None = None, require_pq: bool = False) -> DataFrame:
    """The rows of ASSESSED: what reports need of each artifact, with its signatures checked where it is decoded.

    Bytes cross to Python once. Pinned keys are held by every worker if there are HELD_KEYS at most; beyond that they are
    joined, for which signed bytes cross a second time.
    """
    held = held_keys(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = row_of(k, d, True) | {"checked": []}
                if held is not None:
                    signed = [dict(zip(("key", "basis"), pinned_key(s["signer"], held))) | s for s in r.get("signatures") or []]
                    r["checked"] = [{n: s[n] for n in ("signer", "algorithm", "basis")} | {"status": signature_status(s | {"body": r["body"]}, require_pq)} for s in signed]
                    r["body"] = None
                nodes = r.get("payload") or []
                r["refs"] = [ref for n in nodes for ref in n["refs"]]
                r["confidence"] = sum(n["confidence"]["mean"] for n in nodes) / len(nodes) if nodes else None
                r["event"], r["roles"] = r.get("event"), r.get("signer_roles")
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=ASSESSED)

    rows = files.select(F.col(key).cast("string").alias("artifact_id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, spark_schema(ASSESSED))
    if held is not None:
        return cut(rows.drop("body"))
    rows = cut(rows)
    by = verified(rows, known, require_pq).groupBy(F.col("artifact_id").alias("_a")).agg(F.collect_list(F.struct("signer", "algorithm", "status", "basis")).alias("_checked"))
    return cut(rows.drop("body").join(by, F.col("artifact_id") == F.col("_a"), "left").withColumn("checked", F.coalesce("_checked", "checked")).drop("_a", "_checked"))


def told_of(rows: DataFrame, statements: DataFrame | None) -> DataFrame:
    """Revocation statements by artifact, each different one once: those about its digest, from elsewhere or in any artifact, as a
    statement in one copy counts for all copies."""
    good = rows.filter("decode.ok")
    told = good.select(F.explode("revocations").alias("r")).select("r.*")
    if statements is not None:
        told = told.unionByName(statements.select(*told.columns))
    own = good.select("artifact_id", F.col("artifact_digest").alias("_d"), F.transform("signatures", lambda s: F.struct(s["signer"].alias("signer"), s["algorithm"].alias("algorithm"))).alias("signed"))
    return told.distinct().join(own, F.col("artifact_digest") == F.col("_d")).drop("_d")


def authentic(told: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """artifact_id and applies, for rows of told_of(): whether the statement's signer signed the artifact and signed the statement, with a
    pinned key if the id is known, with the same algorithm. Hybrid statements need both components, for which there is no backend here."""
    k = told.sparkSession.createDataFrame([], "_s string, _k string") if known is None else known.select(F.col("signer").alias("_s"), F.col("key_b64").alias("_k")).dropDuplicates(["_s"])
    met = told.join(k, F.col("signer") == F.col("_s"), "left").withColumn("key", F.when(F.col("_s").isNotNull(), F.coalesce("_k", F.lit(""))).otherwise(F.col("signer")))
    met = met.withColumn("algorithm", F.get(F.filter("signed", lambda s: s["signer"] == F.col("signer")), F.lit(0))["algorithm"])
    schema = pa.schema([("artifact_id", pa.string()), ("applies", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.to_pylist():
                raw = ed25519.raw_key(s["key"] or "") if s["algorithm"] == "ed25519" else None
                good = bool(raw and not ed25519.weak(raw) and s["signature"] and s["issued_ms"] is not None and s["reason"] is not None) and ed25519.verify(raw, A.statement_bytes(s), s["signature"])
                out.append({"artifact_id": s["artifact_id"], "applies": bool(good)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return met.select("artifact_id", "artifact_digest", "signer", "issued_ms", "reason", "signature", "key", "algorithm").mapInArrow(run, "artifact_id string, applies boolean")


def anchored(rows: DataFrame, tsa_keys: DataFrame | None = None) -> DataFrame:
    """artifact_id and timestamp_status of artifacts with a time anchor; tsa_keys: (authority, key_b64)."""
    anchors = rows.filter("decode.ok AND timestamp_anchor IS NOT NULL").select("artifact_id", "artifact_digest", "timestamp_anchor.*")
    if tsa_keys is None:
        return anchors.select("artifact_id", F.lit("unverified").alias("timestamp_status"))
    k = tsa_keys.select(F.col("authority").alias("_t"), F.col("key_b64").alias("_k")).dropDuplicates(["_t"])
    schema = pa.schema([("artifact_id", pa.string()), ("timestamp_status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw = ed25519.raw_key(r["_k"] or "")
                good = raw and not ed25519.weak(raw) and ed25519.verify(raw, A.anchor_bytes(r["artifact_digest"], r["time_ms"]), r["token"] or b"")
                out.append({"artifact_id": r["artifact_id"], "timestamp_status": "verified" if good else "unverified"})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return anchors.join(k, F.col("authority") == F.col("_t"), "left").select("artifact_id", "artifact_digest", "time_ms", "token", "_k").mapInArrow(run, "artifact_id string, timestamp_status string")


def report(rows: DataFrame, known: DataFrame | None = None, statements: DataFrame | None = None, bundle: DataFrame | None = None, tsa_keys: DataFrame | None = None, malformed: int = 0, source_failed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """trust_report() of assessed() rows, with further columns of theirs."""
    from provspark.operators import trust

    status = F.when(~F.col("decode.ok"), "INVALID").otherwise(trust.document_status(F.transform("checked", lambda s: s["status"])))
    docs = rows.select("artifact_id", F.col("decode.error_class").alias("error_class"), "artifact_digest", "content_id", F.greatest(F.size("checked"), F.lit(0)).alias("n_signatures"), F.col("decode.ok").alias("_ok"), status.alias("_status"), F.col("checked").alias("signatures"), *(keep or []))
    zero, none = F.lit(0), F.lit(None).cast("string")
    met = authentic(told_of(rows, statements), known).select("artifact_id", F.col("applies").cast("int").alias("applied"), (~F.col("applies")).cast("int").alias("forged"), zero.alias("found"), zero.alias("lost"), none.alias("at"))
    refs = rows.filter("decode.ok").select("artifact_id", F.explode("refs").alias("ref")).filter(is_cross(F.col("ref")))
    empty = rows.sparkSession.createDataFrame([], "content_id string, node_id string")
    found = trust.references(refs, bundle if bundle is not None else empty).select("artifact_id", zero.alias("applied"), zero.alias("forged"), (F.col("status") == "resolved").cast("int").alias("found"), (F.col("status") == "unresolved").cast("int").alias("lost"), none.alias("at"))
    times = anchored(rows, tsa_keys).select("artifact_id", zero.alias("applied"), zero.alias("forged"), zero.alias("found"), zero.alias("lost"), F.col("timestamp_status").alias("at"))
    by = met.unionByName(found).unionByName(times).groupBy(F.col("artifact_id").alias("_a")).agg(*(F.sum(c).alias(f"_{c}") for c in ("applied", "forged", "found", "lost")), F.max("at").alias("_at"))
    n = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    valid = F.col("_status") == "VALID"
    lowered = F.when(valid & (n("applied") > 0), "REVOKED").when(valid & F.lit(source_failed), "UNVERIFIABLE").otherwise(F.col("_status"))
    out = docs.join(by, F.col("artifact_id") == F.col("_a"), "left").withColumn("trust_status", lowered)
    return out.select(
        "artifact_id", "trust_status", "error_class", "artifact_digest", "content_id", "n_signatures", n("applied").alias("revocations_applied"), (n("forged") + F.when(F.col("_ok"), malformed).otherwise(0)).alias("forged_revocations"), n("found").alias("refs_resolved"), n("lost").alias("refs_unresolved"),
        F.coalesce("_at", F.lit("absent")).alias("timestamp_status"), "signatures", trust.exit_code(F.col("trust_status")).alias("exit_code"), *(keep or []),
    )


def trust_report(files: DataFrame, key: str, content: str, known: DataFrame | None = None, statements: DataFrame | None = None, bundle: DataFrame | None = None, require_pq: bool = False, **more) -> DataFrame:
    """One row for each artifact: its trust status and what led to it.

    known: (signer, key_b64) of pinned keys, for signatures and for revocation statements. statements: revocations from
    elsewhere; those that artifacts carry count as well. malformed: statements from elsewhere that couldn't be
    read as such, which count as forged. source_failed: a source of statements couldn't be read, so nothing is VALID.
    bundle: (content_id, node_id) that references may resolve to. tsa_keys: (authority, key_b64) of those whose time
    anchors count. Artifacts that can't be decoded are INVALID, with the error. signatures names for each signature its
    algorithm, status, and basis: whether the key was pinned or is what the signer id says. Decoded once, into a checkpoint.
    """
    return report(assessed(files, key, content, known, require_pq), known, statements, bundle, **more)


def keystore_checked(rows: DataFrame, revoked: DataFrame) -> DataFrame:
    """The columns that policy.evaluate() takes, for assessed() rows with a keystore's keys as the known ones: signatures in order, each
    first by its key, then by its validity, then by whether the key is revoked; the first that fails decides key_status, else it is ok.

    revoked: (signer). Only keys of the store count, a signer id that describes itself doesn't; hybrid signatures need a backend
    that isn't here, so they are invalid. key_status is null for unsigned artifacts and those that can't be decoded.
    """
    gone = revoked.select(F.col("signer").alias("_r")).distinct()
    one = rows.filter("decode.ok").select("artifact_id", F.posexplode("checked").alias("pos", "s")).select("artifact_id", "pos", "s.*").join(gone, F.col("signer") == F.col("_r"), "left")
    state = F.when(F.col("algorithm") == "ed25519+ml-dsa-65", "invalid").when(F.col("basis") != "pinned", "unknown").when((F.col("algorithm") != "ed25519") | (F.col("status") != "valid"), "invalid").when(F.col("_r").isNotNull(), "revoked").otherwise("ok")
    by = one.withColumn("state", state).groupBy(F.col("artifact_id").alias("_a")).agg(F.coalesce(F.min(F.when(F.col("state") != "ok", F.struct("pos", "state")))["state"], F.lit("ok")).alias("key_status"))
    error = F.when(F.col("decode.ok"), "").when(F.col("decode.error_class") == "checksum", "Checksum mismatch").otherwise(F.concat(F.lit("format: "), F.lower("decode.error")))
    docs = rows.select("artifact_id", error.alias("decode_error"), F.get("signatures", F.lit(0))["signer"].alias("signer"), F.col("provenance.source_model").alias("model"), "confidence")
    return docs.join(by, F.col("artifact_id") == F.col("_a"), "left").drop("_a")


def verified_json(rows: DataFrame) -> DataFrame:
    """artifact_id and json of assessed() rows that decode: what they are, with _signed, and _verified where they are signed."""
    signed = F.size("signatures") > 0
    ok = F.forall("checked", lambda s: s["status"] == "valid")
    what = F.struct("artifact_id", "artifact_digest", "content_id", "provenance", "confidence", F.transform("checked", lambda s: s["signer"]).alias("signers"), signed.alias("_signed"), F.when(signed, ok).alias("_verified"))
    return rows.filter("decode.ok").select("artifact_id", F.to_json(what).alias("json"))


def audit(files: DataFrame, key: str, content: str, fields: list[str], known: DataFrame | None = None, require_pq: bool = False, **how) -> DataFrame:
    """The trust report with how many of the named provenance fields are filled in, and whether all are."""
    from provspark.operators import export

    met = report(assessed(files, key, content, known, require_pq), known, keep=["provenance"], **how)
    return export.complete(met, F.col("provenance"), fields).drop("provenance")


def handoff(files: DataFrame, key: str, content: str, expected_signer: str, **how) -> DataFrame:
    """(artifact_id, accepted, reason): whether another party's artifacts are VALID and signed by whom they should be."""
    met = trust_report(files, key, content, **how)
    signed = F.exists("signatures", lambda s: s["signer"] == expected_signer)
    reason = F.when(F.col("trust_status") != "VALID", F.lower("trust_status")).when(~F.coalesce(signed, F.lit(False)), "unexpected_signer").otherwise("accepted")
    return met.select("artifact_id", (reason == "accepted").alias("accepted"), reason.alias("reason"))


def exported(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """artifact_id, compact (JSON) and packed (MessagePack), in the format's layouts for exchange; nulls for what can't be decoded."""
    schema = pa.schema([("artifact_id", pa.string()), ("compact", pa.string()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    doc = A.decode(d or b"")
                    out.append({"artifact_id": k, "compact": layouts.to_compact(doc), "packed": layouts.to_packed(doc)})
                except A.Invalid:
                    out.append({"artifact_id": k})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select(F.col(key).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "artifact_id string, compact string, packed binary")


def imported(rows: DataFrame, column: str, key: str = "artifact_id") -> DataFrame:
    """(artifact_id, content, error): artifacts, unsigned, from a column of exported(), compact or packed; an error where the checksum or the shape is wrong."""
    read = layouts.from_compact if column == "compact" else layouts.from_packed
    schema = pa.schema([("artifact_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out.append({"artifact_id": k, "content": A.encode(read(x) | {"signatures": []}), "error": ""})
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    out.append({"artifact_id": k, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.filter(F.col(column).isNotNull()).select(F.col(key).alias("artifact_id"), column).mapInArrow(run, "artifact_id string, content binary, error string")
