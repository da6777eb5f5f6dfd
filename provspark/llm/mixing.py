"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. The cells' token weights are raked until
their marginals over sources, languages and topics equal the targets: that gives each cell's factor.
Probabilities are raked anew with the bound of 1 inside the iteration, to the same targets of the asked share of
all tokens: what a cell at the bound lacks, the other cells of its source, language and topic make up for.
A value that has fewer tokens than its target asks for is kept whole, and the rest of its target goes to
the others of its side in proportion.

Only tokens by cell are summed over the corpus, map-side first, so a hot source is a few partial sums.
Raking works on the cells: on the driver up to CELLS of them, and beyond that as DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import BLANK_CHARS, BLANKS, cut, nested

SIDES = ("source", "lang", "topic")
COLUMNS = ("doc_id", "text", "source", "lang")
CELLS, ROUNDS, CLOSE = 1_000_000, 100, 1e-9
#: Cells up to which their table is broadcast, so that texts stay where they are; beyond that the optimizer decides.
BROADCAST = 100_000
#: The targets unless others are given: shares of tokens to this power, so large groups give way to small ones.
TEMPER = 0.7
#: The share of all tokens that is kept.
KEEP = 0.8
SEED = 42


def topic(text: Column) -> Column:
    """A coarse topic from the look of a text: table, markup, numeric or prose; blank if it has no word."""
    size = F.char_length(text)
    share = lambda members: F.char_length(F.regexp_replace(text, f"[^{members}]+", "")) / size
    return F.when(~text.rlike(f"[^{BLANKS}]"), "blank").when(share("|") > 0.02, "table").when(share("#*$%&<>{}") > 0.02, "markup").when(share("0-9") > 0.02, "numeric").otherwise("prose")


def placed(docs: DataFrame, topics: str = "") -> DataFrame:
    """docs with _m_source, _m_lang, _m_topic (of the column topics, if one is named; null: empty) and _m_tokens, the words of the text and one for its end."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    side = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    inner = F.trim(text, F.lit(BLANK_CHARS))
    words = F.when(inner == "", 0).otherwise(F.size(F.split(inner, f"[{BLANKS}]+"))) + 1
    return docs.withColumns({"_m_source": side("source"), "_m_lang": side("lang"), "_m_topic": side(topics) if topics else topic(text), "_m_tokens": words.cast("bigint")})


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*(F.col(f"_m_{s}").alias(s) for s in SIDES)).agg(F.sum("_m_tokens").cast("double").alias("tokens"))


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in totals.items()}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(names: list[tuple[str, ...]], tokens: np.ndarray, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """A factor for each cell: cells' tokens times factors have the target shares on every side, as far as they can.

    targets: by side, the share of each value; values that are missing get none, a missing side is
    tempered. Targets of values that the corpus lacks go to the others in proportion.
    """
    factor = np.ones(len(tokens))
    sides = []
    for k, side in enumerate(SIDES):
        values, at = np.unique([n[k] for n in names], return_inverse=True)
        have = np.bincount(at, tokens, len(values))
        want = dict((targets or {}).get(side) or tempered(dict(zip(values.tolist(), have.tolist())), TEMPER))
        share = np.array([want.get(v, 0.0) for v in values.tolist()])
        sides.append((at, share / share.sum() if share.sum() else share, len(values)))
    total = tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for at, share, n in sides:
            have = np.bincount(at, tokens * factor, n)
            step = np.divide(share * total, have, out=np.zeros(n), where=have > 0)
            factor *= step[at]
            worst = max(worst, float(np.abs(step[have > 0] - 1).max(initial=0)))
        if worst < CLOSE:
            break
    return factor


def bounded_goals(have: np.ndarray, share: np.ndarray, asked: float) -> np.ndarray:
    """Tokens to keep of each value: asked tokens by their shares, at most have; what a value lacks goes to the others in proportion."""
    goal, whole = np.zeros(len(have)), share <= 0
    while not whole.all():
        left = max(0.0, asked - goal[whole].sum())
        goal[~whole] = share[~whole] / share[~whole].sum() * left
        over = ~whole & (goal > have)
        if not over.any():
            break
        goal[over], whole = have[over], whole | over
    return goal


def bounded(names: list[tuple[str, ...]], tokens: np.ndarray, factor: np.ndarray, keep: float, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """A probability for each cell, so that cells' tokens times it have bounded_goals() on every side, as far as they can together.

    Begins with rake()'s factors. Each value's multiplier is found exactly, with the cells that reach 1 under it left at 1. The last
    step brings the whole to the asked share of tokens, where the cells with a factor have as many.
    """
    x = np.where(factor > 0, factor, 0.0)
    sides = []
    for k, side in enumerate(SIDES):
        values, at = np.unique([n[k] for n in names], return_inverse=True)
        all_of, have = np.bincount(at, tokens, len(values)), np.bincount(at, tokens * (x > 0), len(values))
        want = dict((targets or {}).get(side) or tempered(dict(zip(values.tolist(), all_of.tolist())), TEMPER))
        share = np.array([want.get(v, 0.0) for v in values.tolist()])
        sides.append((at, bounded_goals(have, share, keep * tokens.sum()), have))
    for _ in range(rounds):
        worst = 0.0
        for at, goal, have in sides:
            step = multipliers(at, x, tokens, goal, have)
            kept = np.bincount(at, tokens * np.minimum(1, x), len(goal))
            worst = max(worst, float(np.abs(kept - goal).max(initial=0)))
            x = np.clip(x * step[at], 0.0, 1e100)
        if worst < CLOSE * tokens.sum():
            break
    return np.minimum(1, x * scale(tokens, x, keep))


def multipliers(at: np.ndarray, x: np.ndarray, tokens: np.ndarray, goal: np.ndarray, have: np.ndarray) -> np.ndarray:
    """By value, the number m for which its cells' tokens times least(1, m x) add up to its goal; where that is all it has, all reach 1."""
    order = np.lexsort((-x, at))
    a, v, t = at[order], x[order], tokens[order]
    first = np.searchsorted(a, np.arange(len(goal)))
    before = lambda y: (total := np.concatenate([[0.0], np.cumsum(y)]))[:-1] - total[first][a]
    rest = np.bincount(a, t * v, len(goal))[a] - before(t * v)
    by = np.divide(goal[a] - before(t), rest, out=np.full(len(a), np.inf), where=(rest > 0) & (v > 0))
    fits = (by * v <= 1 + 1e-12) & (by >= 0)
    out = np.ones(len(goal))
    at_fit = np.nonzero(fits)[0][::-1]
    least = np.full(len(goal), np.inf)
    np.minimum.at(least, at[x > 0], x[x > 0])
    whole = (goal >= have * (1 - 1e-12)) & np.isfinite(least)
    out[a[at_fit]] = by[at_fit]  # the first that fits, as the last that is set
    out[whole] = np.maximum(1.0, 1 / least[whole])
    return out


def bounded_frames(table: DataFrame, keep: float, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """bounded() for any number of cells: the table with a column x, the probability before its cut at 1.

    A value's multiplier is the ratio of its goal and what it keeps, which approaches the exact one from its own side.
    """
    spark = table.sparkSession
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    now = cut(table.withColumn("x", F.col("factor")))
    goals = {}
    for side in SIDES:
        given = (targets or {}).get(side)
        sizes = now.groupBy(F.col(side).alias("v")).agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("x") > 0, F.col("tokens")).otherwise(0.0)).alias("have"))
        raw = sizes.withColumn("share", F.pow("all", F.lit(TEMPER))) if not given else sizes.join(spark.createDataFrame(list(given.items()), "v string, share double"), "v")
        goals[side] = cut(goals_frame(cut(raw.filter("share > 0").select("v", "have", "share")), keep * total))
    for _ in range(rounds):
        worst = 0.0
        for side in SIDES:
            kept = now.groupBy(F.col(side).alias("h")).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), "x")).alias("kept"))
            step = cut(kept.join(goals[side], F.col("h") == F.col("v"), "left").select("h", F.when(F.col("kept") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("kept")).otherwise(0.0).alias("step"), F.abs(F.col("kept") - F.coalesce("goal", F.lit(0.0))).alias("off")))
            now = now.join(step.select("h", "step"), F.col(side) == F.col("h")).withColumn("x", F.col("x") * F.col("step")).drop("h", "step")
            worst = max(worst, step.agg(F.max("off")).first()[0] or 0.0)
        now = cut(now)
        if worst < CLOSE * total:
            break
    return now


def goals_frame(raw: DataFrame, asked: float) -> DataFrame:
    """bounded_goals() of (v, have, share): v and goal. Values whose tokens run out first come first; a round settles those that do."""
    level = 0.0
    while True:
        # Values with have <= level * share are whole; the level rises until what is left goes by shares.
        whole = F.col("have") <= level * F.col("share")
        settled, left = raw.agg(F.sum(F.when(whole, F.col("have"))), F.sum(F.when(~whole, F.col("share")))).first()
        if not left:
            break
        above = max(0.0, asked - (settled or 0.0)) / left
        if above <= level * (1 + 1e-15):
            break
        level = above
    return raw.select("v", F.least(F.col("have"), level * F.col("share")).alias("goal"))


def rake_frames(table: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """rake() for any number of cells: the table with a column factor. Lineage is cut in each round."""
    spark = table.sparkSession
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    now = cut(table.withColumn("factor", F.lit(1.0)))
    goals = {}
    for side in SIDES:
        given = (targets or {}).get(side)
        raw = now.groupBy(side).agg(F.pow(F.sum("tokens"), F.lit(TEMPER)).alias("share")) if not given else spark.createDataFrame(list(given.items()), f"{side} string, share double").join(now.select(side).distinct(), side)
        whole = raw.agg(F.sum("share")).first()[0]
        goals[side] = cut(raw.select(F.col(side).alias("v"), (F.col("share") / whole).alias("share")))
    for _ in range(rounds):
        worst = 0.0
        for side in SIDES:
            have = now.groupBy(F.col(side).alias("h")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("have"))
            step = cut(have.join(goals[side], F.col("h") == F.col("v"), "left").select("h", F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("have")).otherwise(0.0).alias("step"), "have"))
            now = now.join(step.select("h", "step"), F.col(side) == F.col("h")).withColumn("factor", F.col("factor") * F.col("step")).drop("h", "step")
            worst = max(worst, step.filter("have > 0").agg(F.max(F.abs(F.col("step") - 1))).first()[0] or 0.0)
        now = cut(now)
        if worst < CLOSE:
            break
    return now


def scale(tokens: np.ndarray, factor: np.ndarray, keep: float) -> float:
    """The number by which factors, then cut at 1, keep a share of the tokens, or all tokens of cells with a factor."""
    order = np.argsort(-factor, kind="stable")
    t, f = tokens[order], factor[order]
    whole = np.cumsum(t) - t  # tokens of cells that are kept whole if this one is the first that isn't
    rest = np.cumsum((t * f)[::-1])[::-1]
    by = np.divide(keep * tokens.sum() - whole, rest, out=np.full(len(f), np.inf), where=rest > 0)
    fits = np.nonzero((by * f <= 1) & (by >= 0))[0]
    return float(by[fits[0]]) if len(fits) else 1 / f[f > 0].min() if (f > 0).any() else 0.0


def scale_frames(table: DataFrame, keep: float, rounds: int = 40) -> float:
    """scale() for any number of cells, by halving an interval."""
    low, high = table.agg(F.lit(0.0), (1 / F.min(F.when(F.col("factor") > 0, F.col("factor"))))).first()
    if not high:
        return 0.0
    for _ in range(rounds):
        mid = (low + high) / 2
        less = table.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), mid * F.col("factor"))) < keep * F.sum("tokens")).first()[0]
        low, high = (mid, high) if less else (low, mid)
    return high


def probabilities(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, most: int = CELLS) -> DataFrame:
    """By cell of placed(): source, lang, topic, tokens, factor and probability."""
    spark = rows.sparkSession
    table = cut(cells(rows))
    n = table.count()
    if n <= most:
        got = table.orderBy(*SIDES).collect()  # most rows at most, as counted
        tokens = np.array([r.tokens for r in got], float)
        names = [tuple(r[s] for s in SIDES) for r in got]
        factor = rake(names, tokens, targets)
        p = bounded(names, tokens, factor, keep, targets)
        made = [(*n, r.tokens, float(f), float(x)) for n, r, f, x in zip(names, got, factor, p)]
        out = spark.createDataFrame(made, "source string, lang string, topic string, tokens double, factor double, probability double")
    else:
        raked = bounded_frames(rake_frames(table, targets), keep, targets)
        by = scale_frames(raked.select("tokens", F.col("x").alias("factor")), keep)
        out = raked.withColumn("probability", F.least(F.lit(1.0), F.col("x") * by)).drop("x")
    return F.broadcast(out) if n <= BROADCAST else out


def drawn(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of placed() with _m_p and _m_kept: a number from 0 to 1 that doc_id, the text and the seed fix is below the probability."""
    goal = table.select(*(F.col(s).alias(f"_g_{s}") for s in SIDES), F.col("probability").alias("_m_p"))  # keeps the hint
    at = [F.col(f"_m_{s}") == F.col(f"_g_{s}") for s in SIDES]
    lot = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return rows.join(goal, at, "left").withColumn("_m_kept", lot < F.coalesce("_m_p", F.lit(0.0)))


def given(targets: DataFrame) -> dict[str, dict[str, float]]:
    """Targets by side from a table (side, value, share), of CELLS rows at most."""
    rows = targets.select("side", "value", F.col("share").cast("double").alias("share")).limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        raise ValueError(f"more than {CELLS} targets")
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        if r.side not in SIDES or r.share is None or r.share < 0:
            raise ValueError(f"no target: {r}")
        out.setdefault(r.side, {})[r.value or ""] = r.share
    return out


def chosen(targets: Mapping[str, Mapping[str, float]] | DataFrame | None) -> Mapping[str, Mapping[str, float]] | None:
    return given(targets) if isinstance(targets, DataFrame) else targets


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | DataFrame | None = None, keep: float = KEEP, topics: str = "") -> DataFrame:
    """Every document with its cell, weight, probability and whether it is drawn.

    doc_id, source, lang, topic, n_tokens, probability, kept. targets: shares by side and value, or a table (side, value, share).
    topics: a column of docs with topics; else they are told from a text's look. Nulls in source, lang or topic are a value of their
    own, the empty string; a null text has the topic blank and one token, its end. Very long texts are counted whole. Equal rows are drawn
    alike. An empty table gives an empty result. Other columns are ignored.
    """
    rows = placed(docs.select(*COLUMNS, *([topics] if topics else [])), topics)
    out = drawn(rows, probabilities(rows, chosen(targets), keep))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(f"_m_{s}").alias(s) for s in SIDES), F.col("_m_tokens").alias("n_tokens"), F.round("_m_p", 9).alias("probability"), F.col("_m_kept").alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | DataFrame | None = None, keep: float = KEEP, topics: str = "") -> DataFrame:
    """The rows of docs, with all their columns, that mixed() would draw. Texts are neither shuffled nor written."""
    rows = placed(nested(docs, *COLUMNS, *([topics] if topics else [])), topics)
    return drawn(rows, probabilities(rows, chosen(targets), keep)).filter("_m_kept").select("row.*")
