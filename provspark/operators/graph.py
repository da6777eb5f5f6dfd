"""Graphs of nodes or steps, many at once: (graph, id) rows and (graph, id, dep) edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.shared import cut


def duplicates(nodes: DataFrame) -> DataFrame:
    """(graph, id, n) of ids that occur more than once."""
    return nodes.groupBy("graph", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(edges: DataFrame, nodes: DataFrame, exempt: str = "") -> DataFrame:
    """Edges whose dep is no node of their graph; deps that begin with exempt may be."""
    have = nodes.select(F.col("graph").alias("_g"), F.col("id").alias("_i"))
    lost = edges.join(have, (F.col("graph") == F.col("_g")) & (F.col("dep") == F.col("_i")), "left_anti")
    return lost.filter(~F.col("dep").startswith(exempt)) if exempt else lost


#: Nodes and links of a graph up to which a task folds it whole. The format allows 20,000 nodes.
WHOLE = 200_000


def stuck(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(graph, id) of nodes on a cycle or depending on one: what is left after taking away, again and again, nodes without open deps.

    Graphs of up to whole nodes and links are folded each in a task, spread by graph; only larger ones, if there are any,
    are peeled by joins. Dangling deps don't hold a node.
    """
    every = nodes.select("graph", "id").distinct()
    rows = cut(every.withColumn("dep", F.lit(None).cast(edges.schema["dep"].dataType)).unionByName(edges.select("graph", "id", "dep").distinct()))
    sizes = rows.groupBy(F.col("graph").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.filter(F.col("_n") > whole).select("_g"))
    small = rows.join(large, F.col("graph") == F.col("_g"), "left_anti").repartition("graph").sortWithinPartitions("graph")
    folded = small.mapInArrow(fold, every.schema)
    if large.isEmpty():
        return folded
    of = lambda df: df.join(large, F.col("graph") == F.col("_g"), "left_semi")
    return folded.unionByName(peeled(of(every), of(edges.select("graph", "id", "dep"))))


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (graph, id, dep), a null dep for each node, sorted by graph, to the stuck nodes; one graph is held at a time."""
    own, ids, deps, kinds, names = None, [], {}, [], ["graph", "id"]

    def told() -> pa.RecordBatch:
        left = in_row_stuck(ids, [deps.get(i, []) for i in ids])
        return pa.RecordBatch.from_arrays([pa.array([own] * len(left), kinds[0]), pa.array(left, kinds[1])], names=names)

    for b in batches:
        kinds = [b.schema.field(n).type for n in names]
        for g, i, d in zip(*(b.column(n).to_pylist() for n in ("graph", "id", "dep"))):
            if g != own and ids:
                yield told()
                ids, deps = [], {}
            own = g
            if d is None:
                ids.append(i)
            else:
                deps.setdefault(i, []).append(d)
    if ids:
        yield told()


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """stuck() by joins, for graphs of any size.

    Each round also contracts chains: a node with one open dep shares its fate, so what depends on it depends on the
    end of its chain instead. Rounds go on until one changes nothing; lineage is cut in each.
    """
    every = nodes.select("graph", "id").distinct()
    links = cut(edges.select("graph", "id", "dep").distinct().join(every, ["graph", "id"], "left_semi").join(every.withColumnRenamed("id", "dep"), ["graph", "dep"], "left_semi").select("graph", "id", "dep"))
    fate = every.withColumn("rep", F.col("id"))
    before, now = -1, links.count()
    while now not in (before, 0):
        held = cut(links.join(links.select("graph", F.col("id").alias("dep")).distinct(), ["graph", "dep"], "left_semi").select("graph", "id", "dep"))
        ends = chain_ends(held)
        fate = cut(renamed(fate, ends, "rep"))
        others = renamed(held.join(ends, ["graph", "id"], "left_anti"), ends, "dep")
        links = cut(others.unionByName(ends.filter("id = end").select("graph", "id", F.col("end").alias("dep"))).distinct())
        before, now = now, links.count()
    return fate.join(links.select("graph", F.col("id").alias("rep")).distinct(), ["graph", "rep"], "left_semi").select("graph", "id")


def chain_ends(links: DataFrame) -> DataFrame:
    """(graph, id, end) of nodes with one dep: the first node down the chain with none or several, or itself if the chain runs into a ring.

    By doubling, as often as the longest possible chain needs: no more than a graph has such nodes.
    """
    one = cut(links.groupBy("graph", "id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("end")).filter("n = 1").select("graph", "id", "end"))
    jump = one
    for _ in range((one.groupBy("graph").count().agg(F.max("count")).first()[0] or 0).bit_length()):
        jump = cut(renamed(jump, jump, "end"))
    ring = one.select("graph", F.col("id").alias("end"), F.lit(True).alias("ring"))
    return cut(jump.join(ring, ["graph", "end"], "left").select("graph", "id", F.when(F.col("ring"), F.col("id")).otherwise(F.col("end")).alias("end")))


def renamed(df: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """df with its column's nodes replaced by their ends, if they have one."""
    to = ends.select("graph", F.col("id").alias(column), F.col("end").alias("_end"))
    return df.join(to, ["graph", column], "left").withColumn(column, F.coalesce("_end", column)).select(*df.columns)


def in_row_stuck(ids: list[str], deps: list[list[str]]) -> list[str]:
    """stuck() for one small graph, in the order of ids."""
    known, out = set(ids), {}
    degree = {}
    for i, d in zip(ids, deps):
        inner = {x for x in d if x in known}
        degree[i] = len(inner)
        for x in inner:
            out.setdefault(x, []).append(i)
    ready = [i for i, n in degree.items() if not n]
    for i in ready:
        for j in out.get(i, ()):
            degree[j] -= 1
            if not degree[j]:
                ready.append(j)
    return [i for i in ids if degree[i]]


def declared_depth(ids: list[str], deps: list[list[str]]) -> dict[str, int]:
    """Indentation by declaration order: one more than the deepest dep declared so far, 0 without deps."""
    depth: dict[str, int] = {}
    for i, d in zip(ids, deps):
        depth[i] = max((depth.get(x, 0) + 1 for x in d), default=0)
    return depth


class Incremental:
    """A growing graph that refuses a step which would close a cycle; deps may come before their steps."""

    def __init__(self) -> None:
        self.deps: dict[str, list[str]] = {}

    def add(self, step: str, deps: list[str]) -> str | None:
        """An error, or nothing if the step was added. A refused step leaves the graph as it was."""
        if step in self.deps:
            return f"duplicate step {step}"
        seen, todo = set(), list(deps)
        while todo:
            x = todo.pop()
            if x == step:
                return f"cycle through {step}"
            if x not in seen:
                seen.add(x)
                todo += self.deps.get(x, ())
        self.deps[step] = list(deps)
        return None
