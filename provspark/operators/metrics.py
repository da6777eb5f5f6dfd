"""Aggregations: confidences, percentiles, run summaries, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.functions.scalars import clamp


def confidence_summary(nodes: DataFrame, key: str, mean: str = "mean", var: str = "var") -> DataFrame:
    """By key: n_nodes, confidence_mean (1 without any) and confidence_var (0 without any)."""
    return nodes.groupBy(key).agg(F.count(mean).alias("n_nodes"), F.coalesce(F.avg(mean), F.lit(1.0)).alias("confidence_mean"), F.coalesce(F.avg(var), F.lit(0.0)).alias("confidence_var"))


def logprob_confidence(tokens: DataFrame, key: str, probability: str) -> DataFrame:
    """By key: mean and population variance of token probabilities, cut to [0, 1]; of a single token 0.05."""
    by = tokens.groupBy(key).agg(F.count(probability).alias("n_tokens"), F.avg(probability).alias("_m"), F.var_pop(probability).alias("_v"))
    return by.select(key, "n_tokens", clamp(F.col("_m")).alias("mean"), F.when(F.col("n_tokens") == 1, 0.05).otherwise(clamp(F.col("_v"))).alias("var"))


def run_summary(samples: DataFrame, keys: Sequence[str], value: str, ok: Column) -> DataFrame:
    """By keys: n, ok, mean and population deviation (0 for one), rounded to one place."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(value), 1).alias("mean"), F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), 1).alias("stdev"))


def percentiles(samples: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float] = (50, 90, 99)) -> DataFrame:
    """By keys: linearly interpolated percentiles p50, ..."""
    return samples.groupBy(*keys).agg(*[F.percentile(value, p / 100).alias(f"p{p:g}") for p in ps])


def nearest_ranks(samples: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float] = (50, 90, 99)) -> DataFrame:
    """By keys: the value at index min(n - 1, round(p / 100 * n)), halves to even.

    Counts by value come first, so a hot key is as many rows as it has different values.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    running = counts.withColumns({"_end": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda p: F.least(F.col("_all") - 1, F.bround(F.lit(p / 100) * F.col("_all"), 0).cast("bigint"))
    return running.groupBy(*keys).agg(*[F.min(F.when(F.col("_end") > at(p), F.col(value))).alias(f"p{p:g}") for p in ps])


def numeric_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form: for each key and column, n, mean, population deviation, and for booleans the number of true."""
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(dict(df.dtypes)[c] == "boolean").alias("is_flag")) for c in columns]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*").filter("value IS NOT NULL")
    return long.groupBy(*keys, "name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("stdev"), F.count_if(F.col("is_flag") & (F.col("value") != 0)).alias("n_true"))


def judge_scores(scores: DataFrame, group: str, criterion: str, score: str) -> DataFrame:
    """By group and criterion: n, mean, min, max and deviation; and the group's mean of the criteria's means, as criterion '*'."""
    by = scores.groupBy(group, criterion).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("lowest"), F.max(score).alias("highest"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("stdev"))
    whole = by.groupBy(group).agg(F.lit("*").alias(criterion), F.sum("n").alias("n"), F.avg("mean").alias("mean"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.coalesce(F.stddev_pop("mean"), F.lit(0.0)).alias("stdev"))
    return by.unionByName(whole.select(by.columns))


def fidelity(df: DataFrame, losses: Sequence[Column]) -> DataFrame:
    """Adds losses and score: 1 less a tenth for each loss, 0 at least."""
    n = sum((x.cast("int") for x in losses), F.lit(0))
    return df.withColumns({"losses": n, "score": F.greatest(F.lit(0.0), 1 - 0.1 * n)})


def mixture_valid(alternatives: DataFrame, key: str, weight: str, normalized: Column, tolerance: float = 0.01) -> DataFrame:
    """By key: n, total and valid: weights are finite and, if normalized, in [0, 1] with a sum of 1 within tolerance."""
    finite = ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    by = alternatives.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total"), F.bool_and(finite).alias("_finite"), F.bool_and(F.col(weight).between(0, 1)).alias("_range"), F.bool_and(normalized).alias("_normal"))
    return by.select(key, "n", "total", (F.col("_finite") & (~F.col("_normal") | (F.col("_range") & (F.abs(F.col("total") - 1) <= tolerance)))).alias("valid"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of equal length, null if one is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0)))


def covariance_ok(embedding: Column, covariance: Column) -> Column:
    """No covariance, or a square one of the embedding's size."""
    n = F.size(embedding)
    return (F.size(covariance) <= 0) | ((F.size(covariance) == n) & F.forall(covariance, lambda r: F.size(r) == n))


def distribution_ok(mean: Column, var: Column, p5: Column, p95: Column) -> Column:
    """The range rules of an uncertain value; absent percentiles are fine."""
    unit = lambda x: x.isNull() | (~F.isnan(x) & x.between(0, 1))
    finite = ~F.isnan(var) & (var != float("inf")) & (var >= 0)
    return F.coalesce(mean.isNotNull() & unit(mean) & finite & unit(p5) & unit(p95) & (p5.isNull() | p95.isNull() | (p5 <= p95)), F.lit(False))


def judgments(df: DataFrame, response: str, rubric: list[str], unread: int = 3) -> DataFrame:
    """df with criterion, score and justification, a row for each criterion of the rubric, from a judge's answer in the agreed form.

    A block begins with a line CRITERION: name; its lines SCORE: and JUSTIFICATION: count wherever they stand in it, the last one of
    each. A score that is no whole number, or none, is unread; of blocks of one name the last counts, and one that is missing is unread.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    after = lambda lines, head: F.get(F.filter(lines, lambda x: x.startswith(head)), F.size(F.filter(lines, lambda x: x.startswith(head))) - 1)
    value = lambda line, head: F.trim(F.substr(line, F.lit(len(head) + 1)))
    blocks = F.transform(F.split(F.coalesce(response, F.lit("")), "\nCRITERION:"), lambda b: F.split(F.trim(b, F.lit(" \t\r\n")), "\r?\n"))
    named = F.transform(blocks, lambda lines: F.named_struct(F.lit("name"), F.trim(F.replace(lines[0], F.lit("CRITERION:"), F.lit(""))), F.lit("s"), after(lines, "SCORE:"), F.lit("j"), after(lines, "JUSTIFICATION:")))
    rows = df.select(*kept, named.alias("_b"), F.explode(F.array(*[F.lit(c) for c in rubric])).alias("criterion"))
    own = F.filter("_b", lambda b: b["name"] == F.col("criterion"))
    rows = rows.withColumn("_own", F.get(own, F.size(own) - 1))
    score = value(F.col("_own.s"), "SCORE:")
    return rows.select(
        *kept, "criterion", F.coalesce(F.when(score.rlike(r"^[+-]?[0-9]{1,9}$"), score.cast("int")), F.lit(unread)).alias("score"),
        F.when(F.col("_own").isNull(), "Could not parse judgment.").otherwise(F.coalesce(value(F.col("_own.j"), "JUSTIFICATION:"), F.lit(""))).alias("justification"),
    )
