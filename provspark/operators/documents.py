"""Documents from recorded calls, and what follows from their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failed(nodes: DataFrame, key: str) -> DataFrame:
    """By key: status, failed if any tool result is an error, else ok."""
    bad = (F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))
    return nodes.groupBy(key).agg(F.when(F.bool_or(bad), "failed").otherwise("ok").alias("status"))


def envelope(nodes: DataFrame, key: str) -> DataFrame:
    """By key: tool_count, error_count, total_ms and status of a task."""
    bad = (F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))
    return nodes.groupBy(key).agg(F.count_if(F.col("type") == "tool_result").alias("tool_count"), F.count_if(bad).alias("error_count"), F.coalesce(F.sum("latency_ms"), F.lit(0).cast("bigint")).alias("total_ms"), F.when(F.bool_or(bad), "failed").otherwise("ok").alias("status"))


def paired(calls: DataFrame, results: DataFrame, call: str, order: str) -> DataFrame:
    """calls with the first result, by order, of the same call id; has_result is false without any."""
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy(call).orderBy(order))).filter("_n = 1").drop("_n")
    return calls.join(first.withColumnRenamed(call, "_c"), F.col(call) == F.col("_c"), "left").withColumn("has_result", F.col("_c").isNotNull()).drop("_c")


def nodes_of_calls(df: DataFrame, calls: str = "calls", results: str = "results", text: str = "text") -> DataFrame:
    """Adds nodes: the calls, then the results, then the text, with their positions; and trace: one thought after another from the array thoughts, if there is one."""
    node = lambda kind, body, ref: F.struct(F.lit(kind).alias("type"), body.cast("string").alias("value"), ref.cast("string").alias("call_id"))
    parts = F.concat(
        F.transform(calls, lambda c: node("tool_call", c["name"], c["call_id"])),
        F.transform(results, lambda r: node("tool_result", r["content"], r["call_id"])),
        F.array(node("text", F.col(text), F.lit(None))),
    )
    out = df.withColumn("nodes", F.transform(parts, lambda n, i: F.struct(F.concat(F.lit("n"), i).alias("id"), n["type"].alias("type"), n["value"].alias("value"), n["call_id"].alias("call_id"))))
    if "thoughts" in df.columns:
        thought = lambda t, i: F.struct(F.concat(F.lit("thought_"), i).alias("id"), t.alias("content"), F.when(i > 0, F.array(F.concat(F.lit("thought_"), i - 1))).otherwise(F.array().cast("array<string>")).alias("deps"))
        out = out.withColumn("trace", F.transform("thoughts", thought))
    return out


def in_sequence(df: DataFrame, stream: str, node: str, order: str, seq: str) -> DataFrame:
    """Adds status of each fragment: ok; error at a stream's first fragment whose seq isn't above all before it of its node; cut after that."""
    own = Window.partitionBy(stream, node).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_bad", F.coalesce(F.col(seq) <= F.max(seq).over(own), F.lit(False)).cast("int"))
    upto = Window.partitionBy(stream).orderBy(order)
    prior = F.coalesce(F.max("_bad").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("status", F.when(prior == 1, "cut").when(F.col("_bad") == 1, "error").otherwise("ok")).drop("_bad")


def assembled(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """By keys: n_parts and the text, put together in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parts"), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("assembled"))


def bound(assembled_text: Column, node_text: Column, resumed: Column) -> Column:
    """Whether streamed text is the committed node's: equal, or its end if the stream was resumed."""
    return F.when(resumed, F.endswith(node_text, assembled_text)).otherwise(assembled_text == node_text)
