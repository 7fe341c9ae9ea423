"""Distances, parents and subtree sums in large graphs, in few rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def _tidy(edges: DataFrame) -> DataFrame:
    """Each pair once (a < b), with its least weight."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))


def _spread(edges: DataFrame, roots: DataFrame, rounds: int | None, compact: int = 8) -> tuple[DataFrame, bool]:
    """Distances from the roots (node, dist), a round for each further edge of the paths, and whether they are final.

    A round writes the nodes that it has brought nearer; what is known is the least over these tables, which become one every `compact` rounds.
    """
    both = _both(edges)
    front = materialize(roots.select("node", F.lit(0).cast("long").alias("dist")).distinct())
    known, n = [front], 0
    least = lambda tables: reduce(DataFrame.unionAll, tables).groupBy("node").agg(F.min("dist").alias("dist"))
    while rounds is None or n < rounds:
        n += 1
        step = front.join(both, front["node"] == both["u"]).groupBy(F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("to"))
        front = materialize(step.join(least(known), "node", "left").where("dist is null or to < dist").select("node", F.col("to").alias("dist")))
        if front.isEmpty():
            return least(known), True
        known = [*known, front] if len(known) < compact else [materialize(least([*known, front]))]
    return least(known), False


def _chains(core: DataFrame, roots: DataFrame) -> DataFrame:
    """For each directed edge (u, v) of the core: where the chain of inner nodes behind it ends, and its length.

    Inner nodes have two neighbours and aren't roots. Each directed edge knows the next one of its chain; these pointers double, so a chain
    of n edges takes log2 n rounds. Rings without another node have no end and go.
    """
    both = materialize(_both(core))
    inner = materialize(both.groupBy("u").agg(F.count("*").alias("n")).where("n = 2").select(F.col("u").alias("node")).join(roots, "node", "left_anti"))
    onward = both.join(inner.select(F.col("node").alias("u")), "u").select(F.col("u").alias("v"), F.col("v").alias("x"))
    first = both.join(onward, "v", "left").where("x is null or x <> u")
    rows = materialize(first.select("u", "v", F.when(F.col("x").isNotNull(), F.col("v")).alias("nu"), F.col("x").alias("nv"), F.col("v").alias("end"), F.col("w").alias("len")))
    for _ in range(max(1, rows.count()).bit_length() + 1):
        if rows.where("nu is not null").isEmpty():
            break
        ahead = rows.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"), F.col("end").alias("end2"), F.col("len").alias("len2"))
        moved = rows.where("nu is not null").join(ahead, ["nu", "nv"]).select("u", "v", F.col("nu2").alias("nu"), F.col("nv2").alias("nv"), F.col("end2").alias("end"), (F.col("len") + F.col("len2")).alias("len"))
        rows = materialize(rows.where("nu is null").unionByName(moved))
    return materialize(rows.where("nu is null").join(inner.select(F.col("node").alias("u"), F.lit(True).alias("inner")), "u", "left").select("u", "end", "len", F.coalesce("inner", F.lit(False)).alias("inner")))


def distances(edges: DataFrame, roots: DataFrame, hops: int | None = None) -> DataFrame:
    """node, dist: the length of the shortest path from the nearest root (node), for all nodes that one reaches.

    edges: a, b, w (a long above 0), undirected. Where every node is at most `hops` edges away (8, or log2 of the number of edges if that is more), each hop is a join. Deeper graphs are contracted: nodes with one
    neighbour and chains of nodes with two go, the rest is solved in the same way, and what went takes its distance from the
    ends that stayed. A chain of n nodes so takes about log2 n rounds, and a tree as many contractions as its size halves.
    """
    edges, roots = materialize(_tidy(edges)), materialize(roots.select("node").distinct())
    most = max(8, edges.count().bit_length()) if hops is None else hops  # a contraction takes as many rounds or more
    found, final = _spread(edges, roots, most)
    return found if final else _contracted(edges, roots)


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    n = edges.count()
    both = _both(edges)
    lone = materialize(both.groupBy("u").agg(F.count("*").alias("n")).where("n = 1").select(F.col("u").alias("node")).join(roots, "node", "left_anti"))
    leaves = both.join(lone.select(F.col("node").alias("u")), "u")
    core = edges
    for end in ("a", "b"):
        core = core.join(lone.select(F.col("node").alias(end)), end, "left_anti")
    chains = _chains(materialize(core), roots)
    inner = chains.where("inner")
    hubs = chains.where("not inner").join(inner.select(F.col("u").alias("end")).distinct(), "end", "left_anti")
    left = materialize(_tidy(hubs.select(F.col("u").alias("a"), F.col("end").alias("b"), F.col("len").alias("w"))))
    if 2 * left.count() <= n:
        found, final = _spread(left, roots, 2)
        found = found if final else _contracted(left, roots)
    else:
        found = _spread(left, roots, None)[0]
    found = materialize(found)
    between = inner.join(found.withColumnRenamed("node", "end"), "end").groupBy(F.col("u").alias("node")).agg(F.min(F.col("dist") + F.col("len")).alias("dist"))
    known = found.unionAll(between)
    ends = leaves.join(known.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
    return materialize(known.unionAll(ends))


def nearest_parents(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """node, parent: of a node's neighbours one edge nearer to the roots, the smallest; edges all count 1."""
    far = dist.select(F.col("node").alias("u"), F.col("dist").alias("d"))
    near = dist.select(F.col("node").alias("v"), (F.col("dist") + 1).alias("d"))
    return _both(edges).join(far, "u").join(near, ["v", "d"]).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent"))


def below(tree: DataFrame) -> DataFrame:
    """node, n: the nodes below each one in a forest (node, parent or null).

    After round k a node has counted those less than 2^k levels below it and knows its 2^k-th ancestor; the next round adds the counts of
    the nodes whose ancestor it is. A round has one row for each node, and a forest of depth d takes log2 d rounds.
    """
    rows = materialize(tree.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n")))
    while not rows.where("up is not null").isEmpty():
        more = rows.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("more"))
        onward = rows.select(F.col("node").alias("up"), F.col("up").alias("next"))
        rows = materialize(rows.join(more, "node", "left").join(onward, "up", "left").select("node", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return rows.select("node", (F.col("n") - 1).alias("n"))
