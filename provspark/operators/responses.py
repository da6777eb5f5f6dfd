"""Recorded responses of model providers, in the JSON of their public interfaces, as documents; native columns only.

All three shapes are read by one permissive schema and become the same columns: nodes (tool calls, results of executed tools,
the text), a trace of thoughts or of hidden reasoning, and a confidence from token probabilities where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of what providers answer, what documents take; other fields are ignored.
SHAPE = """model string, modelVersion string,
choices array<struct<message: struct<content: string, tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>>>>, logprobs: struct<content: array<struct<logprob: double>>>>>,
usage struct<completion_tokens_details: struct<reasoning_tokens: bigint>>,
content array<struct<type: string, text: string, thinking: string, id: string, name: string, input: string>>,
candidates array<struct<content: struct<parts: array<struct<text: string, thought: boolean>>>, logprobs_result: struct<chosen_candidates: array<struct<log_probability: double>>>>>"""
#: Fixed values: (mean, var) without token probabilities: plain, and of an answer after visible thoughts.
PLAIN, THOUGHT = (0.85, 0.05), (0.92, 0.03)
#: Fixed value: the one step that stands for reasoning that isn't shown.
HIDDEN = "[OpenAI internal reasoning — %s tokens, text not exposed by API]"


def either(*columns: Column) -> Column:
    """The first array that isn't null, else an empty one."""
    return F.coalesce(*columns, F.array())


def parsed(df: DataFrame, response: str = "response", results: str = "") -> DataFrame:
    """df with model, nodes, trace, n_probabilities, mean and var, for a column of responses; JSON that can't be read gives an empty text.

    results: a column array<struct<call_id, content, error_type, latency_ms>> of executed tools; an error_type makes an error.
    """
    r = F.col("_r")
    openai, gemini = F.get(r["choices"], F.lit(0)), F.get(r["candidates"], F.lit(0))
    blocks, parts = either(r["content"]), either(gemini["content"]["parts"])
    call = lambda i, name, given: F.struct(F.concat(F.lit("tool_call_"), i).alias("id"), F.lit("tool_call").alias("type"), F.to_json(F.struct(name.alias("name"), given.alias("arguments"), i.alias("call_id"))).alias("value"))
    calls = F.concat(
        F.transform(either(openai["message"]["tool_calls"]), lambda c: call(c["id"], c["function"]["name"], c["function"]["arguments"])),
        F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: call(b["id"], b["name"], b["input"])),
    )
    joined = lambda xs: F.array_join(xs, "")
    text = F.concat(
        F.coalesce(openai["message"]["content"], F.lit("")),
        joined(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])),
        joined(F.transform(F.filter(parts, lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"])),
    )
    seen = F.filter(parts, lambda p: p["text"].isNotNull() & F.coalesce(p["thought"], F.lit(False)))
    thoughts = F.concat(F.transform(F.filter(blocks, lambda b: b["type"] == "thinking"), lambda b: b["thinking"]), F.when(F.size(seen) > 0, F.array(joined(F.transform(seen, lambda p: p["text"])))).otherwise(F.array().cast("array<string>")))
    logs = F.concat(F.transform(either(openai["logprobs"]["content"]), lambda x: x["logprob"]), F.transform(either(gemini["logprobs_result"]["chosen_candidates"]), lambda x: x["log_probability"]))
    out = df.withColumn("_r", F.from_json(response, SHAPE))
    out = out.withColumns({"_calls": calls, "_text": text, "_thoughts": thoughts, "_p": F.transform(F.filter(logs, lambda x: x.isNotNull()), F.exp), "_hidden": F.coalesce(r["usage"]["completion_tokens_details"]["reasoning_tokens"], F.lit(0))})
    n = F.size("_p")
    mean = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p) / n
    spread = F.aggregate("_p", F.lit(0.0), lambda a, p: a + (p - F.col("_mean")) * (p - F.col("_mean"))) / n
    visible = F.size("_thoughts") > 0
    out = out.withColumn("_mean", F.when(n > 0, mean))
    done = F.array().cast("array<struct<id:string,type:string,value:string>>")
    if results:
        one = lambda x: F.struct(
            F.concat(F.lit("tool_result_"), x["call_id"]).alias("id"), F.lit("tool_result").alias("type"),
            F.to_json(F.struct(x["call_id"].alias("call_id"), x["content"].alias("content"), x["error_type"].isNotNull().alias("is_error"), x["error_type"].alias("error_type"), F.round(x["latency_ms"], 2).alias("latency_ms"))).alias("value"),
        )
        done = F.transform(F.coalesce(results, F.array()), one)
    answer = F.array(F.struct(F.lit("response").alias("id"), F.lit("text").alias("type"), F.col("_text").alias("value")))
    none = F.array().cast("array<struct<id:string,type:string,value:string>>")
    before = F.concat("_calls", done)
    step = lambda i, content, deps: F.struct(i.alias("id"), F.lit("hypothesis").alias("type"), content.alias("content"), deps.alias("deps"))
    roots = F.array().cast("array<string>")
    shown = F.transform("_thoughts", lambda t, i: step(F.concat(F.lit("thought_"), i), t, F.when(i > 0, F.array(F.concat(F.lit("thought_"), i - 1))).otherwise(roots)))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return out.select(
        *kept, F.coalesce(r["model"], r["modelVersion"], F.lit("")).alias("model"), F.concat(before, F.when((F.col("_text") != "") | (F.size(before) == 0), answer).otherwise(none)).alias("nodes"),
        F.when(F.col("_hidden") > 0, F.array(step(F.lit("reasoning"), F.format_string(HIDDEN.replace("%s", "%d"), F.col("_hidden")), roots))).otherwise(shown).alias("trace"), n.alias("n_probabilities"),
        F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_mean"))).when(visible, THOUGHT[0]).otherwise(PLAIN[0]).alias("mean"), F.when(n > 1, spread).when(n == 1, 0.05).when(visible, THOUGHT[1]).otherwise(PLAIN[1]).alias("var"),
    )
