"""Documents that name the one before them by its content id.

Chains are windows over (chain, position): one shuffle by chain, no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.operators.shared import cut


def hops(chain: str, position: str) -> Window:
    return Window.partitionBy(chain).orderBy(position)


def linked(df: DataFrame, chain: str, position: str, content: Column) -> DataFrame:
    """Adds content_id, the SHA-256 of content, and context_ref, that of the hop before ('' at the first)."""
    own = df.withColumn("content_id", F.sha2(content.cast("binary"), 256))
    return own.withColumn("context_ref", F.coalesce(F.lag("content_id").over(hops(chain, position)), F.lit("")))


def checked(df: DataFrame, chain: str, position: str, content_id: Column | None = None) -> DataFrame:
    """Adds link_ok: whether context_ref is the content id of the hop before, or '' at the first.

    content_id: what the hops' contents really hash to, if not the column content_id.
    """
    own = df.withColumn("_real", F.col("content_id") if content_id is None else content_id)
    before = F.coalesce(F.lag("_real").over(hops(chain, position)), F.lit(""))
    return own.withColumn("link_ok", F.col("context_ref") == before).drop("_real")


def verdicts(df: DataFrame, chain: str, position: str) -> DataFrame:
    """By chain: hops, broken_links and first_broken (null if none), from link_ok."""
    broken = F.when(~F.col("link_ok"), F.col(position))
    return df.groupBy(chain).agg(F.count(F.lit(1)).alias("hops"), F.count(broken).alias("broken_links"), F.min(broken).alias("first_broken"))


def signed_verdicts(df: DataFrame, chain: str, position: str) -> DataFrame:
    """By chain: hops, ok, and the first bad hop with its reason: its signature isn't valid, or else its link is broken.

    df: chain, position, signature_status, and link_ok of checked().
    """
    bad = F.when(~F.col("signature_status").eqNullSafe(F.lit("valid")), "signature").when(~F.coalesce("link_ok", F.lit(False)), "link")
    first = F.min(F.when(bad.isNotNull(), F.struct(F.col(position).alias("at"), bad.alias("why")))).alias("_f")
    by = df.groupBy(chain).agg(F.count(F.lit(1)).alias("hops"), first)
    return by.select(chain, "hops", F.col("_f").isNull().alias("ok"), F.col("_f.at").alias("bad_hop"), F.col("_f.why").alias("reason"))


def trusted_prefix(df: DataFrame, chain: str, position: str) -> DataFrame:
    """Adds in_trust: whether no link up to this hop is broken. A break taints all that follows."""
    upto = hops(chain, position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("in_trust", F.max((~F.col("link_ok")).cast("int")).over(upto) == 0)


def lineage(df: DataFrame, start: Column, depth: int | None = None) -> DataFrame:
    """content_id, origin and depth of what each start document descends from, by context_ref, to the very first.

    Steps are doubled: each round adds ancestors twice as far away, so rounds number the logarithm of the longest chain;
    lineage is cut in each. Documents that name each other in a ring count once, at their smallest depth.
    depth: walk step by step, at most so many steps back, where a ring repeats.
    """
    links = df.select(F.col("content_id").alias("child"), F.col("context_ref").alias("parent")).filter("parent <> ''").dropDuplicates(["child"])
    now = df.filter(start).select(F.col("content_id").alias("origin"), "content_id", F.lit(0).alias("depth")).distinct()
    if depth is None:
        return doubled(now, links)
    out = now
    for _ in range(depth):
        now = step(now, links)
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def doubled(now: DataFrame, links: DataFrame) -> DataFrame:
    """now, rows of depth 0, with all ancestors by links (child, parent), until a round finds no new pair."""
    out, jump, far = cut(now), cut(links), 1
    have = out.count()
    while True:
        further = out.join(jump, F.col("content_id") == F.col("child")).select("origin", F.col("parent").alias("content_id"), (F.col("depth") + far).alias("depth"))
        out = out.unionByName(further).groupBy("origin", "content_id").agg(F.min("depth").alias("depth"))
        out = cut(out)
        before, have = have, out.count()
        if have == before:
            return out
        after = jump.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
        jump = cut(jump.join(after, F.col("parent") == F.col("_c")).select("child", F.col("_p").alias("parent")))
        far *= 2


def step(now: DataFrame, links: DataFrame) -> DataFrame:
    return now.join(links, F.col("content_id") == F.col("child")).select("origin", F.col("parent").alias("content_id"), (F.col("depth") + 1).alias("depth"))


def manifest_checked(manifest: DataFrame, docs: DataFrame, key: str, content: Column) -> DataFrame:
    """key, listed and actual digests, and status: ok, mismatch, missing (a document) or unlisted."""
    real = docs.select(key, F.sha2(content.cast("binary"), 256).alias("actual"))
    both = manifest.select(key, F.col("sha256").alias("listed")).join(real, key, "full")
    return both.withColumn("status", F.when(F.col("actual").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") == F.col("actual"), "ok").otherwise("mismatch"))


def time_ordered(df: DataFrame, chain: str, position: str, ts: str) -> DataFrame:
    """Adds in_order: whether the hop's time isn't before that of the hop before."""
    before = F.lag(ts).over(hops(chain, position))
    return df.withColumn("in_order", before.isNull() | (F.col(ts) >= before))
