"""Exports: spans of telemetry, relations of provenance, and compliance views; native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.scalars import iso_ms, nanos, vendor

#: Span event names by node type.
EVENT_NAMES = {"tool_call": "gen_ai.tool.call", "tool_result": "gen_ai.tool.result"}
STEP_EVENT = "sif.trace.step"


def spans(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One span for each document (artifact_id, model, timestamp_ms) with figures of its nodes (artifact_id, pos, type, mean, is_error, call_id)."""
    tool = F.col("type").isin("tool_call", "tool_result")
    calls = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(tool & (F.col("call_id") != ""), F.struct("pos", "call_id")))), lambda x: x["call_id"]), ",")
    by = nodes.groupBy(F.col("artifact_id").alias("_a")).agg(F.avg("mean").alias("confidence_mean_avg"), F.count(F.lit(1)).alias("n_nodes"), calls.alias("call_ids"), F.bool_or((F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))).alias("_bad"))
    start = nanos(F.col("timestamp_ms"))
    return docs.join(by, F.col("artifact_id") == F.col("_a"), "left").select(
        "artifact_id", F.lit("gen_ai.chat").alias("name"), vendor(F.col("model")).alias("system"), "model", start.alias("start_ns"), (start + F.lit(1_000_000_000).cast("bigint")).alias("end_ns"),
        "confidence_mean_avg", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("call_ids", F.lit("")).alias("call_ids"), F.when(F.col("_bad"), "ERROR").otherwise("OK").alias("status"),
    )


def span_events(docs: DataFrame, nodes: DataFrame, steps: DataFrame | None = None, most: int = 256) -> DataFrame:
    """One event for each node, named by its type, with its whole text; and one for each trace step (as nodes), its text cut to most characters."""
    name = F.lit("gen_ai.content.completion")
    for kind, event in EVENT_NAMES.items():
        name = F.when(F.col("type") == kind, event).otherwise(name)
    own = nodes.select(F.col("artifact_id").alias("_a"), "pos", name.alias("name"), "type", "mean", F.col("text").alias("content"))
    if steps is not None:
        own = own.unionByName(steps.select(F.col("artifact_id").alias("_a"), "pos", F.lit(STEP_EVENT).alias("name"), "type", "mean", F.substring("text", 1, most).alias("content")))
    return docs.join(own, F.col("artifact_id") == F.col("_a")).select("artifact_id", "pos", "name", nanos(F.col("timestamp_ms")).alias("time_ns"), F.col("type").alias("node_type"), F.col("mean").alias("confidence_mean"), "content")


def relations(docs: DataFrame, nodes: DataFrame, deps: DataFrame, steps: DataFrame | None = None, most: int = 512) -> DataFrame:
    """(artifact_id, relation, subject, object, detail) of the provenance model, all in one table.

    docs: artifact_id, model, signer, timestamp_ms; nodes: artifact_id, id, type, text, whole; deps: artifact_id, id, dep;
    steps: artifact_id, id, type, text, of which most characters are kept: an entity and an activity each.
    """
    activity = F.concat(F.lit("inference/"), "model", F.lit("/"), F.col("timestamp_ms").cast("string"))
    agent, signer = F.concat(F.lit("agent/"), "model"), F.concat(F.lit("signer/"), F.substring("signer", 1, 16))
    row = lambda df, relation, a, b, detail=None: df.select("artifact_id", F.lit(relation).alias("relation"), a.alias("subject"), (b if b is not None else F.lit(None).cast("string")).alias("object"), (detail if detail is not None else F.lit("")).alias("detail"))
    signed = docs.filter("signer IS NOT NULL")
    met = nodes.join(docs.select(F.col("artifact_id").alias("_a"), "model", "timestamp_ms"), F.col("artifact_id") == F.col("_a"))
    node = F.concat(F.lit("node/"), "id")
    parts = [
        row(docs, "agent", agent, None, F.lit("SoftwareAgent")),
        row(signed, "agent", signer, None, F.lit("Person")),
        row(docs, "activity", activity, None, iso_ms(F.col("timestamp_ms"))),
        row(docs, "wasAssociatedWith", activity, agent),
        row(signed, "wasAssociatedWith", activity, signer),
        row(met, "entity", node, None, F.col("text")),
        row(met, "wasGeneratedBy", node, activity),
        row(met, "wasAttributedTo", node, agent),
        row(deps, "wasDerivedFrom", F.concat(F.lit("step/"), "id"), F.concat(F.lit("step/"), "dep")),
    ]
    if steps is not None:
        made, by = F.concat(F.lit("step/"), "id"), F.concat(F.lit("step_activity/"), "id")
        at = steps.join(docs.select(F.col("artifact_id").alias("_a"), "timestamp_ms"), F.col("artifact_id") == F.col("_a"))
        parts += [row(at, "entity", made, None, F.substring("text", 1, most)), row(at, "activity", by, None, iso_ms(F.col("timestamp_ms"))), row(at, "wasGeneratedBy", made, by)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complete(docs: DataFrame, fields_of: Column, fields: list[str]) -> DataFrame:
    """docs with present (how many of the fields of a struct are neither null nor ''), asked and complete."""
    present = F.coalesce(sum((fields_of[f].isNotNull() & (fields_of[f].cast("string") != "")).cast("int") for f in fields), F.lit(0))
    return docs.withColumns({"present": present, "asked": F.lit(len(fields)), "complete": present == len(fields)})


def compliance(docs: DataFrame, fields: list[str], key: str = "artifact_id") -> DataFrame:
    """key, present (how many of the fields are neither null nor ''), asked and complete."""
    return complete(docs.select(key, F.struct(*fields).alias("_f")), F.col("_f"), fields).drop("_f")
