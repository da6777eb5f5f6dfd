"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node and root, its component's smallest node, for each node of links(a, b).

    Alternating large-star and small-star rounds: after a logarithmic number of them each node
    points at its root. Every round is two aggregations and joins over the links; no neighbourhood is
    gathered, so a hub is as good as any node. Lineage is cut in each round. Self links and
    repeated links are ignored; no links give no rows.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    told = mark(now)
    while told[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, both.filter("v > u"))
        small = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = cut(star(small, small).distinct())
        was, told = told, mark(now)
        if was == told:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def star(near: DataFrame, moved: DataFrame) -> DataFrame:
    """Links of each u's moved neighbours, and of u itself, to u's smallest neighbour or itself."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = moved.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFF))).first())
