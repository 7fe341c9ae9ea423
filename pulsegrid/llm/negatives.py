"""Hard negatives from a GNAT-style tree: multiway split points with distance ranges to sibling subtrees, exact leaves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import by_key, materialize
from .vectors import squares

LONG = (1 << 63) - 1
#: Rows with a greater component lie in the leaf FAR, which every query opens: squares of others stay far from a double's limits.
MOST, FAR = 2.0**40, -1


def scaled(vectors: pd.Series, scale: float) -> np.ndarray:
    """Whole components: floor(scale * x) in doubles."""
    return np.floor(np.stack(vectors.to_numpy()).astype(float) * scale)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact: in doubles where no sum can pass 2^53, else in Python's integers, held to 64 bits."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < 2.0**53:
        return (x @ y.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m], object) for m in (x, y))
    return np.array([[max(-LONG, min(LONG, int((r * c).sum()))) for c in b] for r in a], np.int64)


@dataclass
class Node:
    """Split points, and for each the subtree of the rows nearest to it: another node, or a leaf's number. ranges[i, j]: least and greatest distance from point i to the rows of subtree j."""

    points: np.ndarray
    below: list[Node | int]
    number: int
    ranges: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    root: Node | int
    nodes: list[Node]
    leaves: int
    norms: np.ndarray = field(default_factory=lambda: np.zeros(0))  # least and greatest squared length in each leaf

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: float, degree: int, seed: int) -> Tree:
        """Split points are drawn far from each other; a part of the sample is cut until it stands for leaf_rows rows or fewer (leaf_rows counts rows of the sample)."""
        tree = cls(0, [], 0)
        rng = np.random.default_rng(seed)

        def grow(x: np.ndarray) -> Node | int:
            if len(x) <= max(1.0, leaf_rows) or (x == x[0]).all():
                tree.leaves += 1
                return tree.leaves - 1
            wanted = max(2, min(degree, math.ceil(len(x) / max(1.0, leaf_rows))))
            points = [x[rng.integers(len(x))]]
            near = squares(x, points[0][None])[:, 0]
            while len(points) < wanted and near.max() > 0:
                points.append(x[near.argmax()])
                near = np.minimum(near, squares(x, points[-1][None])[:, 0])
            node = Node(np.stack(points), [], len(tree.nodes))
            tree.nodes.append(node)
            home = squares(x, node.points).argmin(1)
            node.below = [grow(x[home == j]) if (home == j).any() else grow(node.points[j : j + 1]) for j in range(len(points))]
            return node

        tree.root = grow(sample)
        return tree

    def route(self, x: np.ndarray, seen: Callable[[Node, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """Each row's leaf. seen(node, squared distances to its points, choice) is told of each node that rows pass."""
        leaf = np.where(np.abs(x).max(1) > MOST, FAR, 0).astype(np.int32)
        waiting = [(self.root, np.nonzero(leaf != FAR)[0])]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                leaf[rows] = node
                continue
            d = squares(x[rows], node.points)
            home = d.argmin(1)
            if seen:
                seen(node, d, home)
            waiting += [(child, rows[home == j]) for j, child in enumerate(node.below)]
        return leaf

    def reach(self, x: np.ndarray, fits: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[list[int]]:
        """The leaves that each query x must open, FAR among them.

        A sibling subtree lies, by a split point's range to it, within an annulus around the query; the plane between its own
        split point and the query's nearest one bounds it from below too. fits(rows, least, greatest distance) says which can hold a row in their windows.
        """
        far = np.abs(x).max(1) > MOST
        out: list[list[int]] = [[FAR, *range(self.leaves)] if f else [FAR] for f in far]
        near = np.nonzero(~far)[0]
        waiting = [(self.root, near, np.zeros(len(near)), np.full(len(near), np.inf))]
        while waiting:
            node, rows, low, high = waiting.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                for q in rows:
                    out[q].append(node)
                continue
            d2 = squares(x[rows], node.points)
            d = np.sqrt(d2)
            apart = np.sqrt(squares(node.points, node.points))
            slack = 1e-6 * (1 + d.max())
            for j, child in enumerate(node.below):
                least, most = node.ranges[:, j, 0], node.ranges[:, j, 1]
                if not np.isfinite(least).all():  # no row lies there
                    continue
                below = np.maximum(d - most, least - d).max(1)
                plane = ((d2[:, j][:, None] - d2) / np.maximum(2 * apart[j], 1e-9)).max(1)
                lo = np.maximum(low, np.maximum(below, plane) - slack)
                hi = np.minimum(high, (d + most).min(1) + slack)
                ok = fits(rows, lo, hi)
                waiting.append((child, rows[ok], lo[ok], hi[ok]))
        return out


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", vec: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, sample_rows: int = 16_000, leaf_rows: int = 512, degree: int = 16, cell: int = 1024, queries: int = 512, max_lengths: int = 8, seed: int = 13) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor, over components floor(scale * x). An anchor's positives are its first `positives` other rows
    of the same label, the highest scores first, ties by smaller key; for each of them, its first `negatives` rows of another label whose
    score is between low % of the positive's and the positive's.

    A tree for each frequent vector length (max_lengths of them; other lengths are one leaf) is fitted to a hash sample of about sample_rows
    rows; all rows are routed to its leaves, and distance ranges and lengths come from all of them, so no answer is lost. Three passes
    follow: each anchor's own leaf gives a first bound for its positives, the leaves that can beat it give the positives, and
    the leaves whose annulus meets a window give the negatives. A leaf is cut into cells of about `cell` rows by `queries` anchors, so a leaf of
    equal rows spreads over tasks; a cell returns at most `positives` or `negatives` rows for each anchor and window.

    Rows whose key, label or vector is null, or that hold a null or non-finite component, take no part; an empty vector scores
    0 with its like. Vectors of different lengths aren't compared. Rows with the same key are rows of their own. Scores beyond 64 bits are held to its limits.
    """
    spark = df.sparkSession
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    usable = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    rows = usable.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("k"), F.col(label).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec).cast(kind).alias("vec"))
    rows = materialize(rows, "vectors")

    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).where((F.col("n") > leaf_rows) & (F.col("dim") > 0)).orderBy(F.desc("n"), "dim").limit(max_lengths).collect()
    trees: dict[int, Tree] = {}
    for r in lengths:
        share = min(1.0, sample_rows / len(lengths) / r.n)
        drawn = rows.where((F.size("vec") == r.dim) & (F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).select("row", "vec").limit(4 * sample_rows).toPandas()
        sample = scaled(drawn.sort_values("row")["vec"], scale) if len(drawn) else np.zeros((0, r.dim))
        sample = sample[(np.abs(sample) <= MOST).all(1)]
        if len(sample):
            trees[r.dim] = Tree.fit(sample, leaf_rows * len(sample) / r.n, degree, seed)
    bare = spark.sparkContext.broadcast(trees)  # split points: sample_rows vectors at most

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["vec"].map(len).to_numpy()
            leaf = np.zeros(len(batch), np.int32)
            for dim, tree in bare.value.items():
                at = np.nonzero(dims == dim)[0]
                if len(at):
                    leaf[at] = tree.route(scaled(batch["vec"].iloc[at], scale))
            yield batch.assign(dim=dims.astype(np.int32), leaf=leaf)

    routed = materialize(rows.mapInPandas(route, f"row long, k long, label string, anchor boolean, vec {kind}, dim int, leaf int"), "routed")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ranges of squared distances (node >= 0) and of squared lengths (node -1) over a task's rows."""
        found: dict[tuple[int, int, int, int], tuple[float, float]] = {}

        def add(at: tuple[int, int, int, int], values: np.ndarray) -> None:
            lo, hi = found.get(at, (math.inf, -math.inf))
            found[at] = (min(lo, float(values.min())), max(hi, float(values.max())))

        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim, tree in bare.value.items():
                at = np.nonzero(dims == dim)[0]
                if not len(at):
                    continue
                x = scaled(batch["vec"].iloc[at], scale)

                def seen(node: Node, d: np.ndarray, home: np.ndarray, dim: int = dim) -> None:
                    for j in np.unique(home):
                        for i, values in enumerate(d[home == j].T):
                            add((dim, node.number, i, int(j)), values)

                leaf, size = tree.route(x, seen), (x * x).sum(1)
                for j in np.unique(leaf[leaf != FAR]):
                    add((dim, -1, 0, int(j)), size[leaf == j])
        yield pd.DataFrame([(*at, *r) for at, r in found.items()], columns=["dim", "node", "i", "j", "lo", "hi"])

    ranges = routed.select("vec", "dim").mapInPandas(measure, "dim int, node int, i int, j int, lo double, hi double").groupBy("dim", "node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for tree in trees.values():
        tree.norms = np.tile([math.inf, -math.inf], (tree.leaves, 1))
        for node in tree.nodes:
            node.ranges = np.tile([math.inf, -math.inf], (len(node.points), len(node.points), 1))
    for r in ranges.collect():  # at most degree rows for each split point
        if r.node < 0:
            trees[r.dim].norms[r.j] = r.lo, r.hi
        else:
            trees[r.dim].nodes[r.node].ranges[r.i, r.j] = math.sqrt(r.lo), math.sqrt(r.hi)
    shared = spark.sparkContext.broadcast(trees)

    sizes = routed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.count_if("anchor").alias("q"))
    sizes = materialize(sizes.select("dim", "leaf", F.ceil(F.col("n") / cell).cast("int").alias("nb")), "leaves")
    salt = lambda n: F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.col(n)).cast("int")
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in ("dim", "leaf", "b", "s")]).alias("cell")
    wanted_schema = f"row long, k long, label string, vec {kind}, wanted array<struct<row: long, k: long, score: long>>"

    def run(asked: DataFrame, compare: Callable, schema: str) -> DataFrame:
        """compare(members, queries) over the cells that the queries (row, k, label, vec, wanted, dim, leaf) open. Cells of leaves that no query opens aren't made."""
        load = asked.groupBy("dim", "leaf").agg(F.count("*").alias("nq")).select("dim", "leaf", F.ceil(F.col("nq") / queries).cast("int").alias("ns"))
        shape = sizes.join(load, ["dim", "leaf"])
        columns = ["row", "k", "label", "vec", "wanted"]
        none = F.lit(None).cast(asked.schema["wanted"].dataType).alias("wanted")
        member = routed.select("row", "k", "label", "vec", none, "dim", "leaf").join(shape, ["dim", "leaf"]).withColumn("b", salt("nb")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
        query = asked.join(shape, ["dim", "leaf"]).withColumn("s", salt("ns")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        cells = member.select(name, F.lit(True).alias("member"), *columns).unionAll(query.select(name, F.lit(False).alias("member"), *columns))

        def kernel(_: str, rows: pd.DataFrame) -> pd.DataFrame | None:
            m, q = rows[rows["member"]], rows[~rows["member"]]
            return compare(m, q) if len(m) and len(q) else None

        return by_key(cells, "cell", [], kernel, schema)

    def first(scores: np.ndarray, keys: np.ndarray, numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The n best of these places: highest score, smallest key, smallest row."""
        if len(at) > n:
            at = at[scores[at] >= np.partition(scores[at], len(at) - n)[len(at) - n]]
        return at[np.lexsort((numbers[at], keys[at], -scores[at]))][:n]

    def same(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame | None:
        scores = products(scaled(q["vec"], scale), scaled(m["vec"], scale))
        keys, numbers, labels, out = m["k"].to_numpy(), m["row"].to_numpy(), m["label"].to_numpy(), []
        for s, row, own in zip(scores, q["row"], q["label"]):
            at = first(s, keys, numbers, np.nonzero((labels == own) & (numbers != row))[0], positives)
            out += [(row, numbers[i], keys[i], s[i]) for i in at]
        return pd.DataFrame(out, columns=["anchor", "row", "k", "score"]) if out else None

    found_schema = "anchor long, row long, k long, score long"
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "k", "row")
    anchors = routed.where("anchor").select("row", "k", "label", "vec", "dim", "leaf")
    no_window = F.lit(None).cast("array<struct<row: long, k: long, score: long>>").alias("wanted")
    bounds = run(anchors.select("row", "k", "label", "vec", no_window, "dim", "leaf"), same, found_schema)
    bounds = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("bound"))

    def opening(windows: Callable[[pd.DataFrame], list[np.ndarray]]) -> Callable:
        """Adds the leaves that queries open. windows(batch) gives, for each, the scores (least, greatest) that it looks for."""

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                leaves: list[list[int]] = [[0]] * len(batch)
                sought, dims = windows(batch), batch["dim"].to_numpy()
                for dim, tree in shared.value.items():
                    at = np.nonzero(dims == dim)[0]
                    if not len(at):
                        continue
                    x = scaled(batch["vec"].iloc[at], scale)
                    size = (x * x).sum(1)
                    spans = [sought[i] for i in at]
                    least, most = float(tree.norms[:, 0].min()), float(tree.norms[:, 1].max())

                    def fits(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray = size, spans: list = spans, least: float = least, most: float = most) -> np.ndarray:
                        top, bottom = (size[rows] + most - lo * lo) / 2 + 1, (size[rows] + least - hi * hi) / 2 - 1
                        return np.array([bool(((spans[r][:, 0] <= t) & (spans[r][:, 1] >= b)).any()) for r, t, b in zip(rows, top, bottom)], bool)

                    for i, found in zip(at, tree.reach(x, fits)):
                        leaves[i] = found
                yield batch.drop(columns=[c for c in ("bound", "leaf") if c in batch]).assign(leaves=leaves)[["row", "k", "label", "vec", "wanted", "dim", "leaves"]]

        return probe

    probed = f"{wanted_schema}, dim int, leaves array<int>"
    from_bound = opening(lambda batch: [np.array([[-math.inf if b != b else b, math.inf]]) for b in batch["bound"].astype(float)])
    asked = anchors.join(bounds, "row", "left").select("row", "k", "label", "vec", no_window, "bound", "dim").mapInPandas(from_bound, probed)
    asked = asked.withColumn("leaf", F.explode("leaves")).drop("leaves")
    best = run(asked, same, found_schema).withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    best = materialize(best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", "k", "score")).alias("wanted")), "positives")

    def in_windows(batch: pd.DataFrame) -> list[np.ndarray]:
        return [np.array([[p["score"] * low / 100, p["score"]] for p in ps], float) for ps in batch["wanted"]]

    def other(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame | None:
        scores = products(scaled(q["vec"], scale), scaled(m["vec"], scale))
        keys, numbers, labels, out = m["k"].to_numpy(), m["row"].to_numpy(), m["label"].to_numpy(), []
        for s, row, k, own, wanted in zip(scores, q["row"], q["k"], q["label"], q["wanted"]):
            differs = labels != own
            for p in wanted:
                least = -((-low * int(p["score"])) // 100)  # 100 * score >= low * the positive's
                at = first(s, keys, numbers, np.nonzero(differs & (s >= least) & (s <= p["score"]))[0], negatives)
                out += [(row, k, p["row"], p["k"], p["score"], numbers[i], keys[i], s[i]) for i in at]
        return pd.DataFrame(out, columns=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "k", "score"]) if out else None

    windows = anchors.join(best, "row").select("row", "k", "label", "vec", "wanted", "dim").mapInPandas(opening(in_windows), probed)
    windows = windows.withColumn("leaf", F.explode("leaves")).drop("leaves")
    hits = run(windows, other, "anchor long, anchor_id long, positive long, positive_id long, positive_score long, row long, k long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "k", "row"))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("k").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
