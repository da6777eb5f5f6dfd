"""Queries over spellings, lists and scalar expressions that no other query exercises."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import functions as F

from provspark.codec import artifact as A
from provspark.codec import exchange, keys
from provspark.functions import scalars
from provspark.operators import chain, metrics, responses
from provspark.operators.shared import cut, folder
from provspark.plans.artifacts import NAMED, PUBLIC, built, documents_of
from provspark.plans.registry import query, table
from provspark.plans.relational import CHAIN_SQL, tampered
from provspark.sources import artifacts as S
from provspark.sources import lists
from provspark.sources.datasource import form_of, register


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, conv_id % 6 <> 5 AND conv_id % 2 = 0 AS ok, CASE WHEN conv_id % 6 = 5 THEN 'checksum' WHEN conv_id % 2 = 1 THEN 'signature' ELSE '' END AS error_class FROM (SELECT DISTINCT conv_id FROM conversations)""")
def artifact_files_strict(spark, d):
    """Written as files to the folder that the cluster shares, and read from there by a reader that wants signatures."""
    import uuid

    register(spark)
    path = f"{folder(spark)}/files-{uuid.uuid4().hex}"
    S.write_files(built(spark, d), path)
    rows = S.read(spark, path, require_signature=True)
    return rows.select(F.regexp_extract("artifact_id", r"([^/]*)$", 1).alias("artifact_id"), F.col("decode.ok").alias("ok"), F.col("decode.error_class").alias("error_class"))


def respelled(spark, d, f, schema: pa.Schema, spark_schema: str):
    """f of each artifact that decodes."""

    def run(batches):
        for b in batches:
            out = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    doc = A.decode(data)
                except A.Invalid:
                    continue
                out.append({"artifact_id": k} | f(doc, data))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return built(spark, d).mapInArrow(run, spark_schema)


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, true AS json, true AS msgpack, true AS tampered, count(*) AS n_nodes FROM conversations WHERE conv_id % 6 <> 5 GROUP BY conv_id""")
def respelling_roundtrip(spark, d):
    """Complete JSON and MessagePack, there and back; and whether a changed checksum is noticed."""

    def f(doc: dict, data: bytes) -> dict:
        def noticed(read, text) -> bool:
            try:
                read(text)
            except exchange.Mismatch:
                return True
            return False

        text, packed = exchange.to_json(doc), exchange.to_msgpack(doc)
        again = exchange.from_json(text)
        return {"json": again == doc, "msgpack": exchange.from_msgpack(packed) == doc, "tampered": noticed(exchange.from_json, text.replace('"n0"', '"nX"', 1)), "n_nodes": len(again["payload"])}

    schema = pa.schema([("artifact_id", pa.string()), ("json", pa.bool_()), ("msgpack", pa.bool_()), ("tampered", pa.bool_()), ("n_nodes", pa.int64())])
    return respelled(spark, d, f, schema, "artifact_id string, json boolean, msgpack boolean, tampered boolean, n_nodes long")


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, packing, true AS same_content, CASE packing WHEN '' THEN 0 WHEN 'zlib' THEN 1 ELSE 2 END AS flags2, count(*) AS n_nodes FROM conversations, (SELECT unnest(['', 'zlib', 'zstd']) AS packing) GROUP BY 1, 2""")
def compression_roundtrip(spark, d):
    """Artifacts in each packing: the content id is the same, the header names the packing."""
    docs = documents_of(spark, d).select(F.col("conv_id").cast("string").alias("artifact_id"), "nodes", F.struct(F.lit("model").alias("source_model")).alias("provenance"), F.array().cast("array<string>").alias("signers"))
    read = lambda how: S.decoded(S.simple_documents(docs, packing=how), "artifact_id", "content").select("artifact_id", F.lit(how).alias("packing"), "content_id", "flags2", F.size("payload").cast("bigint").alias("n_nodes"))
    rows = read("").unionByName(read("zlib")).unionByName(read("zstd"))
    same = rows.groupBy(F.col("artifact_id").alias("_a")).agg((F.countDistinct("content_id") == 1).alias("same_content"))
    return rows.join(same, F.col("artifact_id") == F.col("_a")).select("artifact_id", "packing", "same_content", "flags2", "n_nodes")


#: Items of the binary format and what its reader says of their form.
FORMS = (("a2616101616202", "deterministic"), ("a2616201616101", "unsorted"), ("a2616101616102", "malformed"), ("1817", "lax"), ("17", "deterministic"), ("a161", "malformed"), ("9f01ff", "lax"), ("f93c00", "deterministic"))


@query("SELECT doc_id, " + "[" + ", ".join(f"'{f}'" for _, f in FORMS) + f"][doc_id % {len(FORMS)} + 1] AS form FROM documents")
def binary_forms(spark, d):
    register(spark)
    pick = F.element_at(F.array(*[F.lit(h) for h, _ in FORMS]), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.call_function("cbor_form", F.unhex(pick)).alias("form"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS n_good, CASE doc_id % 5 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n_malformed, CASE doc_id % 5 WHEN 3 THEN 'unreadable' WHEN 4 THEN 'malformed' ELSE '' END AS error FROM documents""")
def revocation_lists(spark, d):
    """Lists of statements, some with malformed entries, an empty one, one that isn't JSON and one of a wrong shape."""
    good = '{"artifact_digest":"ab","signer":"s","issued_ms":1,"reason":"retracted","signature":"AAAA"}'
    texts = (f'{{"revocations":[{good},{good}]}}', f'{{"revocations":[{good},7,{good.replace("AAAA", "!")}]}}', '{"revocations":[]}', "{", '{"revocations":{}}')
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("doc_id") % 5 + 1).cast("int")).alias("text"))
    return lists.statements(rows)[1]


@query("""SELECT vec_id, substr(sha256(unhex(list_aggregate(list_transform(embedding[1:32], lambda x: lpad(to_hex((CAST(trunc(CAST(x AS DOUBLE) * 1000) AS BIGINT) % 256 + 256) % 256), 2, '0')), 'string_agg', ''))), 1, 16) AS fingerprint FROM embeddings""")
def embedding_fingerprint(spark, d):
    return table(spark, d, "embeddings").select("vec_id", scalars.vector_fingerprint(F.col("embedding")).alias("fingerprint"))


@query("""SELECT event_id, repeat('█', CAST(round_even(m * 12, 0) AS INT)) || repeat('░', 12 - CAST(round_even(m * 12, 0) AS INT)) AS bar FROM (SELECT event_id, least(1, value / 500) AS m FROM events)""")
def confidence_bars(spark, d):
    return table(spark, d, "events").select("event_id", scalars.confidence_bar(F.least(F.lit(1.0), F.col("value") / 500)).alias("bar"))


@query("SELECT doc_id, url_encode(source || ' ' || lang || '/*é+~_.-' || doc_id) AS slug FROM documents")
def percent_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.slug(F.concat("source", F.lit(" "), "lang", F.lit("/*é+~_.-"), F.col("doc_id").cast("string"))).alias("slug"))


@query("""WITH RECURSIVE r AS (SELECT DISTINCT s_nationkey AS log, ['alice', 'bob', 'carol', 'clock', 'stranger'][s_suppkey % 5 + 1] AS o, ['alice', 'bob', 'carol', 'clock', 'stranger'][(s_suppkey + 1) % 5 + 1] AS n FROM supplier WHERE s_suppkey % 5 <> 4 AND s_suppkey % 7 <> 0),
w AS (SELECT log, o AS signer, n AS now FROM r UNION ALL SELECT w.log, w.signer, r.n FROM w JOIN r ON r.log = w.log AND r.o = w.now)
SELECT log, signer, max(now) AS successor FROM (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.log = w.log AND r.o = w.now)) GROUP BY 1, 2""")
def key_rotation(spark, d):
    """Logs of rotations: each key's last successor by records that both keys signed. One in seven records is signed by a wrong key."""
    pick = lambda k: F.element_at(F.array(*[F.lit(n) for n in NAMED]), (k % 5 + 1).cast("int"))
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").filter(k % 5 != 4).select(F.col("s_nationkey").alias("log"), pick(k).alias("old"), pick(k + 1).alias("new"), (k % 7 == 0).alias("forged"), k.alias("ts"))
    schema = pa.schema([("log", pa.int32()), ("old_signer", pa.string()), ("superseded_by", pa.string()), ("timestamp_ms", pa.int64()), ("proof", pa.string()), ("new_key_proof", pa.string())])

    def sign(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"log": r["log"]} | keys.rotated(NAMED[r["old"]], NAMED["carol" if r["forged"] and r["new"] != "carol" else "bob" if r["forged"] else r["new"]], r["old"], r["new"], r["ts"]) for r in b.to_pylist()], schema=schema)

    log = rows.mapInArrow(sign, "log int, old_signer string, superseded_by string, timestamp_ms long, proof string, new_key_proof string")
    known = spark.createDataFrame([*PUBLIC.items()], "signer string, key_b64 string")
    return lists.successors(log, known, "log").select("log", "signer", "successor")


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, round(avg(1.0::DOUBLE / (turn + 1)), 6) AS mean, count(*) AS n_lines FROM conversations WHERE conv_id % 6 <> 5 GROUP BY 1""")
def rendered_documents(spark, d):
    """Documents for people: as many node lines as nodes, with the confidences that they show."""

    def f(doc: dict, data: bytes) -> dict:
        heads = [x for x in exchange.rendered(doc).split("\n") if x.startswith("[text] n") and ("█" in x or "░" in x)]
        return {"mean": sum(n["confidence"]["mean"] for n in doc["payload"]) / len(doc["payload"]), "n_lines": len(heads)}

    rows = respelled(spark, d, f, pa.schema([("artifact_id", pa.string()), ("mean", pa.float64()), ("n_lines", pa.int64())]), "artifact_id string, mean double, n_lines long")
    return rows.withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, conv_id % 4 AS k FROM conversations)
SELECT conv_id, turn, ['gpt-x', 'claude-x', 'gemini-x', ''][k + 1] AS model, CASE WHEN k = 3 OR turn % 3 = 2 THEN CASE WHEN k < 2 AND turn % 3 = 2 THEN '' ELSE 'text' END ELSE CASE WHEN text = '' AND NOT (k < 2 AND turn % 3 = 1) THEN 'text' WHEN text = '' THEN '' ELSE 'text' END END AS last_kind,
CASE WHEN k < 2 AND turn % 3 > 0 THEN 1 ELSE 0 END AS n_calls, CASE WHEN k < 2 AND turn % 3 > 0 THEN 1 ELSE 0 END AS n_results, CASE WHEN k = 3 OR turn % 3 = 2 THEN '' ELSE text END AS answer, CASE k WHEN 0 THEN CASE WHEN turn % 2 = 1 THEN 'reasoning' END WHEN 1 THEN 'thought_1' WHEN 2 THEN 'thought_0' END AS last_step,
round(CASE WHEN k IN (0, 2) THEN (exp(-0.5::DOUBLE) + exp(-turn::DOUBLE)) / 2 WHEN k = 1 THEN 0.92 ELSE 0.85 END, 9) AS mean, round(CASE WHEN k IN (0, 2) THEN power((exp(-0.5::DOUBLE) - exp(-turn::DOUBLE)) / 2, 2) WHEN k = 1 THEN 0.03 ELSE 0.05 END, 9) AS var, CASE WHEN k < 2 AND turn % 3 = 2 THEN true WHEN k < 2 AND turn % 3 = 1 THEN false END AS failed FROM c""")
def recorded_responses(spark, d):
    """Responses of three providers with tool calls, thoughts and token probabilities, and JSON that can't be read."""
    c, t = F.col("conv_id"), F.col("turn")
    k, call = c % 4, F.concat(F.lit("c"), t.cast("string"))
    text = F.when(t % 3 == 2, F.lit(None).cast("string")).otherwise(F.coalesce("text", F.lit("")))
    logs = lambda name: F.array(*[F.struct(x.alias(name)) for x in (F.lit(-0.5), -t.cast("double"))])
    tool = F.array(F.struct(call.alias("id"), F.struct(F.lit("search").alias("name"), F.lit('{"q":1}').alias("arguments")).alias("function")))
    openai = F.to_json(F.struct(
        F.lit("gpt-x").alias("model"), F.array(F.struct(F.struct(text.alias("content"), F.when(t % 3 > 0, tool).alias("tool_calls")).alias("message"), F.struct(logs("logprob").alias("content")).alias("logprobs"))).alias("choices"),
        F.struct(F.struct(F.when(t % 2 == 1, t).otherwise(0).alias("reasoning_tokens")).alias("completion_tokens_details")).alias("usage"),
    ))
    block = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[(f[n] if n in f else F.lit(None).cast("string")).alias(n) for n in ("text", "thinking", "id", "name")], (F.struct(F.lit(1).alias("q")) if kind == "tool_use" else F.lit(None).cast("struct<q:int>")).alias("input"))
    blocks = F.array(block("thinking", thinking=F.lit("first")), block("thinking", thinking=F.lit("second")), block("text", text=text), block("tool_use", id=call, name=F.lit("search")))
    anthropic = F.to_json(F.struct(F.lit("claude-x").alias("model"), F.filter(blocks, lambda b: (b["type"] != "tool_use") | (t % 3 > 0)).alias("content")))
    parts = F.array(F.struct(F.lit("so ").alias("text"), F.lit(True).alias("thought")), F.struct(F.lit("then").alias("text"), F.lit(True).alias("thought")), F.struct(text.alias("text"), F.lit(False).alias("thought")))
    gemini = F.to_json(F.struct(F.lit("gemini-x").alias("modelVersion"), F.array(F.struct(F.struct(parts.alias("parts")).alias("content"), F.struct(logs("log_probability").alias("chosen_candidates")).alias("logprobs_result"))).alias("candidates")))
    response = F.when(k == 0, openai).when(k == 1, anthropic).when(k == 2, gemini).otherwise("{not json")
    ran = F.when((k < 2) & (t % 3 > 0), F.array(F.struct(call.alias("call_id"), F.lit("found").alias("content"), F.when(t % 3 == 2, "Timeout").alias("error_type"), F.lit(1.234).alias("latency_ms"))))
    got = responses.parsed(table(spark, d, "conversations").select("conv_id", "turn", response.alias("response"), ran.alias("ran")), "response", "ran")
    n = lambda kind: F.size(F.filter("nodes", lambda x: x["type"] == kind))
    of = lambda kind: F.get(F.filter("nodes", lambda x: x["type"] == kind), F.lit(0))["value"]
    return got.select(
        "conv_id", "turn", "model", F.when(n("text") > 0, "text").otherwise("").alias("last_kind"), n("tool_call").alias("n_calls"), n("tool_result").alias("n_results"), F.coalesce(of("text"), F.lit("")).alias("answer"), F.try_element_at("trace", F.lit(-1))["id"].alias("last_step"),
        F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"), F.get_json_object(of("tool_result"), "$.is_error").cast("boolean").alias("failed"),
    )


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, conv_id % 2 = 0 AS signed, CASE WHEN conv_id % 2 = 0 THEN true END AS verified, 'model' AS source_model, CASE WHEN conv_id % 2 = 1 THEN 0 WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END AS n_signers FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 6 <> 5)""")
def verify_to_json(spark, d):
    rows = S.verified_json(S.assessed(built(spark, d), "artifact_id", "content"))
    at = lambda path, kind: F.get_json_object("json", path).cast(kind)
    return rows.select("artifact_id", at("$._signed", "boolean").alias("signed"), at("$._verified", "boolean").alias("verified"), at("$.provenance.source_model", "string").alias("source_model"), F.json_array_length(F.get_json_object("json", "$.signers")).alias("n_signers"))


RUBRIC = ("clarity", "calibration", "sources")


@query("""SELECT doc_id, c AS criterion, CASE WHEN c = 'sources' THEN 3 WHEN c = 'calibration' THEN CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 4 END ELSE doc_id % 5 + 1 END::INT AS score, CASE c WHEN 'sources' THEN 'Could not parse judgment.' WHEN 'calibration' THEN '' ELSE 'because: ' || lang END AS justification
FROM documents, (SELECT unnest(['clarity', 'calibration', 'sources']) AS c)""")
def judge_answers(spark, d):
    """Answers in the agreed form, with a criterion that isn't in the rubric, a score that is no number and a criterion that is missing."""
    score = (F.col("doc_id") % 5 + 1).cast("string")
    text = F.concat(F.lit("\nCRITERION: clarity\nSCORE: 9\nSCORE: "), score, F.lit("\nJUSTIFICATION: because: "), "lang", F.lit("\n\nCRITERION: style\nSCORE: 1\nCRITERION: calibration\nSCORE: "), F.when(F.col("doc_id") % 3 == 0, "four").otherwise("4"), F.lit("\n\nSUMMARY: fine"))
    return metrics.judgments(table(spark, d, "documents").select("doc_id", text.alias("answer")), "answer", list(RUBRIC)).drop("answer")


@query(f"""WITH {CHAIN_SQL}, z AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 2 AND turn = 2 THEN 'signature' WHEN NOT link_ok THEN 'link' END AS why FROM k)
SELECT conv_id, count(*) AS hops, count(why) = 0 AS ok, min(turn) FILTER (why IS NOT NULL) AS bad_hop, arg_min(why, turn) FILTER (why IS NOT NULL) AS reason FROM z GROUP BY conv_id""")
def signed_chains(spark, d):
    status = F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 2), "invalid").otherwise("valid")
    return chain.signed_verdicts(tampered(spark, d).withColumn("signature_status", status), "conv_id", "turn")


@query("""SELECT CAST(conv_id AS VARCHAR) AS artifact_id, 'model' AS model, count(*) AS n_nodes, true AS same_json, true AS same_packed, true AS noticed, first(coalesce(text, '') ORDER BY turn) AS first_value FROM conversations WHERE conv_id % 6 <> 5 GROUP BY conv_id""")
def layouts_for_exchange(spark, d):
    """Exported in both layouts, read by SQL, imported again with the same nodes (the layouts have no place for a nonce, so the content id is another); a changed body is noticed."""
    out = cut(S.exported(built(spark, d), "artifact_id"))
    own = S.decoded(built(spark, d), "artifact_id", "content").filter("decode.ok").select("artifact_id", F.to_json("payload").alias("nodes"), F.size("payload").cast("bigint").alias("n_nodes"))
    again = lambda df, column, name: S.decoded(S.imported(df, column), "artifact_id", "content").select(F.col("artifact_id").alias(f"_{name}"), F.to_json("payload").alias(name))
    changed = S.imported(out.withColumn("compact", F.replace("compact", F.lit('"fmt":"spif"'), F.lit('"fmt":"spiff"'))), "compact").select(F.col("artifact_id").alias("_c"), (F.col("error") != "").alias("noticed"))
    met = own.join(out, "artifact_id").join(again(out, "compact", "j"), F.col("artifact_id") == F.col("_j")).join(again(out, "packed", "p"), F.col("artifact_id") == F.col("_p")).join(changed, F.col("artifact_id") == F.col("_c"))
    return met.select("artifact_id", F.get_json_object("compact", "$.prov.m").alias("model"), "n_nodes", (F.col("j") == F.col("nodes")).alias("same_json"), (F.col("p") == F.col("nodes")).alias("same_packed"), "noticed", F.get_json_object("compact", "$.payload[0].val").alias("first_value"))


@query("""SELECT conv_id, sha256('[' || string_agg('{"content": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ', "role": ' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || '}', ', ' ORDER BY turn) || ']') AS input_hash FROM conversations GROUP BY 1""")
def input_hashes(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", scalars.input_hash(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("input_hash"))


@query("""WITH t AS (SELECT conv_id, turn, conv_id % 3 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS stream_id, 'opened' AS event, NULL::BIGINT AS seq FROM t UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'resumed', 1 FROM t UNION ALL SELECT CAST(conv_id AS VARCHAR), 'partial_text', turn FROM t WHERE turn > 0 AND k > 0
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), CASE WHEN n > 1 AND k < 2 THEN 'error' ELSE 'verified' END, NULL FROM t""")
def stream_resume(spark, d):
    """Streams that go on after their first part: of three one starts below the resume point, and one ends as another text."""
    from provspark.codec import stream
    from provspark.streaming import artifacts as streams

    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))

    def run(batches):
        for b in batches:
            out = []
            for c, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value = "".join(p["text"] for p in ps) + "!" * (c % 3 == 1 and len(ps) > 1)
                node = {"id": "main", "type": "text", "value": value, "confidence": exchange.CERTAIN, "refs": []}
                later = [("main", p["turn"] - (c % 3 == 0), p["text"]) for p in ps[1:]]
                out.append({"path": str(c), "content": stream.written({"payload": [node]}, later, (1, stream.prefix_digest(ps[0]["text"].encode())))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return streams.replayed(parts.mapInArrow(run, "path string, content binary")).select("stream_id", "event", "seq")
