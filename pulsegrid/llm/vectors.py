"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table lookups, exact cosine rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_key, components, discard, materialize, others, shielded
from .links import local_roots

def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; divided by their greatest component first, so that no square overflows or vanishes."""
    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 1024) -> np.ndarray:
    return np.concatenate([squares(x[lo : lo + rows], centres).argmin(axis=1) for lo in range(0, max(1, len(x)), rows)])


@dataclass
class Index:
    """Coarse centres and, for each subspace, a codebook of residuals; fitted to unit vectors of one length."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the exact length of what the code misses, for each row."""
        home = nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        return home, codes.astype(np.uint8), np.sqrt(((rest - self.decode(codes)) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[list[int]]:
        """Lists up to a row's own that can hold a vector within reach.

        A vector of list i is no nearer to the row's own centre than to centre i, so it lies behind the plane half-way
        between them, and the row's distance to that plane is no more than its distance to the vector.
        """
        d = squares(x, self.centres)
        between = np.sqrt(squares(self.centres, self.centres))[home]
        own = d[np.arange(len(x)), home][:, None]
        plane = (d - own) / np.maximum(2 * between, 1e-12)
        ok = (plane <= reach + 1e-6) & (np.arange(len(self.centres))[None, :] <= home[:, None])
        ok[np.arange(len(x)), home] = True
        return [np.nonzero(row)[0].tolist() for row in ok]

    def lookup(self, x: np.ndarray, lists: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from rows x to coded vectors of one list, by a table for each row and subspace."""
        rest = x - self.centres[lists]
        total = np.zeros((len(x), len(codes)), np.float32)
        for s, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            total += squares(rest[:, a:b], book).astype(np.float32)[:, codes[:, s]]
        return total


def fit_index(sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 64, seed: int = 8) -> Index:
    rng = np.random.default_rng(seed)
    centres = k_means(sample, lists, 8, rng)
    rest = sample - centres[nearest(sample, centres)]
    cuts = [round(sample.shape[1] * s / subspaces) for s in range(subspaces + 1)] if sample.shape[1] >= subspaces else [0, sample.shape[1]]
    return Index(centres, [k_means(rest[:, a:b], codes, 8, rng) for a, b in zip(cuts, cuts[1:])], cuts)


def near_duplicate_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.93, sample_rows: int = 16_000, list_rows: int = 384, max_lists: int = 4096, max_lengths: int = 8, cell: int = 512, queries: int = 2048, seed: int = 8) -> DataFrame:
    """Columns of df without the vector, and n_links, component_id, kept: links of cosine >= threshold between rows of equal label.

    Equal vectors of a label are one class and aren't compared. Class vectors are coded by an index of their length, fitted to a
    sample of them (about sample_rows over all lengths; the max_lengths most frequent lengths of which a label has more than list_rows have one, others are one list): coarse inverted lists, and codes of the residual in subspaces. Each
    class probes every list that can hold a link (Index.probes), so no link is lost; in a list, distances come from
    table lookups on the codes, pairs beyond the reach and the code's own error are dropped, the rest get their exact
    cosine in double precision. Lists are cut into cells of `cell` members by `queries` probes, so a hot list spreads over tasks, and a
    cell returns link counts and a spanning forest rather than its pairs.

    A row whose label is null, or whose vector is null, zero, of another length than its partners, or holds null or
    non-finite components, links with nothing. A null key can't name a component: it links with nothing and isn't kept.
    An empty table gives no rows. Columns of df with the added names are replaced, all others come back under their own.
    """
    df, back = shielded(df, [key, vec, label], "n_links", "component_id", "kept")
    spark = df.sparkSession
    kept = [c for c in others(df, "n_links", "component_id", "kept") if c != vec]
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(vec).isNotNull() & ~bad & F.exists(F.col(vec), lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    h1, h2 = (F.when(usable, F.xxhash64(F.lit(s), F.col(label), F.col(vec))) for s in (1, 2))
    rows = df.select(*kept, h1.alias("_h1"), h2.alias("_h2"))
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"  # as they came: floats are half as long on their way
    classes = materialize(df.where(usable).select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(vec).cast(kind).alias("vec"), h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.min("k").cast("long").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")), "vectors")
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    lengths = sizes.where(F.col("most") > list_rows).orderBy(F.desc("n"), "dim").limit(max_lengths).collect()
    indexes: dict[int, Index] = {}
    for r in lengths:  # shorter tables are one list
        share = min(1.0, sample_rows / len(lengths) / r["n"])
        drawn = classes.where((F.size("vec") == r["dim"]) & (F.pmod(F.xxhash64(F.lit(seed), "h1"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).select("rep", "vec").collect()
        sample = np.array([x["vec"] for x in sorted(drawn)], float).reshape(-1, r["dim"])
        if len(sample):
            indexes[r["dim"]] = fit_index(unit(sample), min(max_lists, math.ceil(r["most"] / list_rows), max(1, len(sample) // 4)), seed=seed)
    shared = spark.sparkContext.broadcast(indexes)  # max_lists x dim numbers for each of max_lengths lengths at most
    reach = math.sqrt(2 - 2 * threshold)

    def assign(batches):
        for rows in batches:
            n = rows["vec"].map(len).to_numpy()
            home, err = np.zeros(len(rows), "int32"), np.full(len(rows), np.inf)
            code, probes = np.full(len(rows), b"", object), np.full(len(rows), None, object)
            for at in range(len(rows)):
                probes[at] = [0]
            for dim, ix in shared.value.items():
                fits = np.nonzero(n == dim)[0]
                if len(fits):
                    x = unit(np.stack(rows["vec"].iloc[fits].to_numpy()))
                    home[fits], codes, err[fits] = ix.encode(x)
                    code[fits] = [c.tobytes() for c in codes]
                    for at, p in zip(fits, ix.probes(x, home[fits], reach)):
                        probes[at] = p
            yield rows.assign(home=home, probes=probes, code=code, err=err)[["rep", "copies", "part", "vec", "home", "probes", "code", "err"]]

    part = F.concat_ws(":", F.col("label"), F.size("vec").cast("string"))
    coded = materialize(classes.select("rep", "copies", part.alias("part"), "vec").mapInPandas(assign, f"rep long, copies long, part string, vec {kind}, home int, probes array<int>, code binary, err double"), "codes")
    probed = coded.select("part", F.explode("probes").alias("list"))
    shape = coded.groupBy("part", F.col("home").alias("list")).agg(F.count("*").alias("n")).join(probed.groupBy("part", "list").agg(F.count("*").alias("q")), ["part", "list"])
    shape = shape.select("part", "list", F.ceil(F.col("n") / cell).cast("int").alias("nb"), F.ceil(F.col("q") / queries).cast("int").alias("nq"))
    salt = lambda s, n: F.pmod(F.xxhash64(F.lit(s), F.col("rep")), F.col(n)).cast("int")
    name = F.concat_ws("|", "part", F.col("list").cast("string"), F.col("b").cast("string"), F.col("q").cast("string")).alias("cell")
    columns = ["rep", "copies", "home", "list", "vec", "code", "err"]
    member = coded.withColumn("list", F.col("home")).join(shape, ["part", "list"]).withColumn("b", salt(3, "nb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    query = coded.withColumn("list", F.explode("probes")).join(shape, ["part", "list"]).withColumn("q", salt(4, "nq")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = member.select(name, F.lit(True).alias("member"), *columns).unionAll(query.select(name, F.lit(False).alias("member"), *columns))

    def compare(_: str, rows: pd.DataFrame) -> pd.DataFrame | None:
        m, q = rows[rows["member"]], rows[~rows["member"]]
        if not len(m) or not len(q):
            return None
        x, y = unit(np.stack(m["vec"].to_numpy())), unit(np.stack(q["vec"].to_numpy()))
        xr, yr = m["rep"].to_numpy(), q["rep"].to_numpy()
        err = m["err"].to_numpy()
        if np.isfinite(err).all():
            codes = np.frombuffer(b"".join(m["code"]), np.uint8).reshape(len(m), -1)
            near = shared.value[x.shape[1]].lookup(y, int(m["list"].iat[0]), codes) <= (reach + err[None, :] + 1e-4) ** 2
        else:
            near = np.ones((len(y), len(x)), bool)
        near &= (q["home"].to_numpy() > m["home"].iat[0])[:, None] | (xr[None, :] < yr[:, None])
        b, a = np.nonzero(near)
        if not len(a):
            return None
        ok = np.concatenate([(x[a[i : i + 65536]] * y[b[i : i + 65536]]).sum(1) >= threshold for i in range(0, len(a), 65536)])
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        ids, at = np.unique(np.concatenate([xr[a], yr[b]]), return_inverse=True)
        a_at, b_at = at[: len(a)], at[len(a) :]
        links = np.zeros(len(ids))
        np.add.at(links, a_at, q["copies"].to_numpy()[b])
        np.add.at(links, b_at, m["copies"].to_numpy()[a])
        return pd.DataFrame({"a": ids, "b": ids[local_roots(len(ids), a_at, b_at)], "links": links.astype("int64")})

    found = materialize(by_key(cells, "cell", [], compare, "a long, b long, links long"), "links")
    discard(coded)
    groups = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    done = classes.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(groups, "rep", "left")
    done = done.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    joined = rows.join(done, ["_h1", "_h2"], "left")
    out = joined.select(*kept, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", F.col(key)).cast("long").alias("component_id"))
    return back(out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))
