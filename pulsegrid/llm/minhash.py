"""MinHash near-dedup with an LSH forest and exact links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, CACHES, by_key, components, discard, keep_only, materialize, others, shielded, small, words_of
from .links import local_roots

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _WordHash(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) < 150_000:
            self[word] = value
        return value


_WORDS = _WordHash()
CACHES.append(_WORDS)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `width` lower-case words; fewer words make one run; no words make none."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    run = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        run = _mixed((run ^ h[i : len(h) - width + 1 + i]) * _MIX + np.uint64(i))
    return np.unique(run)


def signature(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One 16-bit min-hash for each seed."""
    low = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    key = _mixed(found)
    a, b = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for lo in range(0, len(a), 2048):
        h = a[lo : lo + 2048, None] * seeds[None, :] + b[lo : lo + 2048, None] * (seeds[None, :] >> np.uint32(7) | np.uint32(1))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, h.min(axis=0))
    return (low ^ low >> np.uint32(16)).astype(np.uint16)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, hashes: int = 96, trees: int = 24, depths: tuple[int, ...] = (4, 6, 9, 14), region: int = 256, loose: float = 0.62, block: int = 384, seed: int = 5) -> DataFrame:
    """Columns of df without its text, and n_shingles, component_id (the smallest key reachable over links), kept.

    Rows link when 100 * shared shingles >= percent * shingles of both. Equal sets are one class, and classes go on:

    1. LSH forest. A class has `hashes` min-hashes, and `trees` seeded orders of them sort the classes. Classes with a common
       prefix of depths[0] hashes in a tree form a region; a region of more than `region` classes is cut by the next
       depth, so depth adapts to each region. What is still too large at the last depth is cut by the rest of the order
       into runs of neighbours, and its first classes join every run. In each region, classes whose signatures
       agree on a share of at least `loose` become candidates: a region returns a spanning forest of them, not pairs.
       Cuts part classes that the first depth would join, so all classes that any tree had in a region too large are joined
       once more on rare shingles, without regions (crowded_links).
    2. The forests' connected components hold every candidate link; each gets its full sets once. A component of
       at most `block` classes is compared exactly in one place. A larger one is cut into blocks that all meet a few pivots;
       then every class outside its largest linked part meets all others, a block of these and a block of those at a time, so that no link
       between parts is lost and no place holds more than that. Exact links too leave as spanning forests.

    Null, empty and wordless texts have no shingles and link with nothing. Rows equal in key and text
    count as one; a null key is never named: it takes its class's smallest key and isn't kept unless it stands alone. An
    empty table gives no rows. Columns of df with the added names are replaced, all others come back under their own.
    """
    df, back = shielded(df, [key, text], "n_shingles", "component_id", "kept")
    rng = np.random.default_rng(seed)
    seeds = (rng.integers(1, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
    orders = [rng.permutation(hashes) for _ in range(trees)]
    kept = [c for c in others(df, "n_shingles", "component_id", "kept") if c != text]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        keep_only(_WORDS)
        for rows in batches:
            for lo in range(0, len(rows), 500):
                some = rows.iloc[lo : lo + 500]
                found = [shingles(t, width) for t in some["_t"]]
                raw = [f.astype("<u8").tobytes() for f in found]
                out = some.drop(columns="_t").assign(n_shingles=list(map(len, found)))
                for n in (1, 2):  # as Int64 from the start: a plain column with nulls would turn to floats
                    out[f"_h{n}"] = pd.array([int.from_bytes(xxhash.xxh64_digest(r, seed=n), "little", signed=True) if r else None for r in raw], "Int64")
                yield out.assign(_sig=[signature(f, seeds).tobytes() if len(f) else None for f in found])

    from pyspark.sql.types import StructType

    schema = StructType([df.schema[c] for c in kept])
    for name, kind in (("n_shingles", "long"), ("_h1", "long"), ("_h2", "long"), ("_sig", "binary")):
        schema = schema.add(name, kind)
    rows = materialize(df.select(*kept, F.col(text).alias("_t")).mapInPandas(describe, schema), "hashes")
    members = rows.drop("_sig")
    named = rows.where(F.col("_h1").isNotNull() & F.col(key).isNotNull())
    classes = materialize(named.groupBy("_h1", "_h2").agg(F.min(F.col(key).cast("long")).alias("rep"), F.first("_sig").alias("sig")), "classes")
    edges, crowd = candidate_links(classes.select("rep", "sig"), orders, hashes, depths, region, loose)
    groups = materialize(components(edges), "groups")
    if not crowd.isEmpty():
        more = crowded_links(df, key, text, classes, crowd, groups, width, percent)
        if not more.isEmpty():
            joined, before = materialize(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "groups"), groups
            groups = joined
            discard(before, more)
    linked = exact_links(shingle_sets(df, key, text, classes, groups, width), percent, block)
    found = components(linked).select(F.col("node").alias("rep"), "component")
    done = classes.join(found, "rep", "left").select("_h1", "_h2", F.coalesce("component", "rep").alias("component_id"))
    done = materialize(done, "done")
    discard(classes, groups, edges, crowd)
    joined = members.join(done, ["_h1", "_h2"], "left")
    own = F.coalesce("component_id", F.col(key)).cast("long")
    out = joined.select(*kept, "n_shingles", own.alias("component_id"))
    alone = F.col(key).isNull() & F.col("component_id").isNull()
    return back(out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), alone)))


def shingle_sets(df: DataFrame, key: str, text: str, classes: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """component, n, node, set for the classes in candidate groups: their sets are cut again from the texts, so that no other text's set is kept."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        keep_only(_WORDS)
        for rows in batches:
            for lo in range(0, len(rows), 500):
                some = rows.iloc[lo : lo + 500]
                raw = [shingles(t, width).astype("<u8").tobytes() for t in some["t"]]
                same = [int.from_bytes(xxhash.xxh64_digest(r, seed=1), "little", signed=True) == h for r, h in zip(raw, some["_h1"])]
                yield some.drop(columns=["t", "_h1"]).assign(set=raw)[same]  # another text under the same key isn't the class

    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    wanted = small(materialize(groups.join(sizes, "component").join(classes.select(F.col("rep").alias("node"), "_h1"), "node"), "wanted"))  # while it is small the texts stay where they are
    texts = df.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t"))
    made = texts.join(wanted, "node").select("component", "n", "node", "t", "_h1").mapInPandas(cut, "component long, n long, node long, set binary")
    return made.groupBy("component", "n", "node").agg(F.first("set").alias("set"))


def crowded_links(df: DataFrame, key: str, text: str, classes: DataFrame, crowd: DataFrame, groups: DataFrame, width: int, percent: int, sample: int = 20_000, common: int = 50_000) -> DataFrame:
    """Candidates (a, b: components, or classes outside any) between the classes of `crowd` (rep), by an exact prefix filter.

    In one total order of all shingles, two sets that link share a shingle of their first len - ceil(percent * len / 100) + 1.
    Any order is right; here shingles that are common in a sample of the crowd come last, so that few sets share a first
    one. Pairs within one component of `groups` are done. The others meet in a join that compares lengths and one bit of each
    min-hash: a linked pair differs in a share of (100 - percent) / 200 of them, and the limit lies six deviations above.
    """
    made = classes.join(crowd, "rep").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    made = materialize(made.select("rep", "_h1", "sig", F.coalesce("component", "rep").alias("part")), "crowd")
    n, keys = made.count(), made.select("rep", "_h1")
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t"))
    texts = materialize(texts.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, "rep"), "crowd")  # the crowd's own texts: no other is shuffled
    every = max(1, n // sample)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
        import xxhash

        keep_only(_WORDS)
        for rows in batches:
            for lo in range(0, len(rows), 500):
                some = rows.iloc[lo : lo + 500]
                found = [shingles(t, width) for t in some["t"]]
                same = [int.from_bytes(xxhash.xxh64_digest(f.astype("<u8").tobytes(), seed=1), "little", signed=True) == h for f, h in zip(found, some["_h1"])]
                yield some[same], [f for f, ok in zip(found, same) if ok]  # another text under the same key isn't the class

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in cut(batches):
            if found:
                yield pd.DataFrame({"s": np.concatenate(found).view(np.int64)})

    few = texts.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(every)) == 0)
    counts = few.mapInPandas(counted, "s long").groupBy("s").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "s").limit(common).toPandas().sort_values("s")
    often, times = top["s"].to_numpy(np.int64), top["count"].to_numpy(np.int64)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, found in cut(batches):
            if not found:
                continue
            heads = []
            for f in found:
                own = f.view(np.int64)
                weight = np.zeros(len(own), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    weight = np.where(often[at] == own, times[at], 0)
                heads.append(own[np.lexsort((own, weight))[: len(own) + (-percent * len(own) // 100) + 1]])
            sigs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1)[:, :128]
            bits = np.zeros((len(rows), 128), np.uint8)
            bits[:, : sigs.shape[1]] = sigs & 1
            bits = np.packbits(bits, axis=1).view(np.int64)
            n = list(map(len, heads))
            yield pd.DataFrame({"s": np.concatenate(heads), "part": np.repeat(rows["part"].to_numpy(np.int64), n), "size": np.repeat(list(map(len, found)), n), "m1": np.repeat(bits[:, 0], n), "m2": np.repeat(bits[:, 1], n)})

    heads = texts.join(made.drop("_h1"), "rep").mapInPandas(first, "s long, part long, size int, m1 long, m2 long")
    own = Window.partitionBy("s")
    met = heads.withColumns({"low": F.min("part").over(own), "high": F.max("part").over(own)}).where("low <> high")
    met = materialize(met.select("s", "part", "size", "m1", "m2", "low"), "heads")
    left = met.where("part <> low").select("s", *[F.col(c).alias(f"{c}_l") for c in ("part", "size", "m1", "m2")])
    n_bits = min(128, len(classes.select("sig").first()[0]) // 2)
    share = (100 - percent) / 200
    most = int(n_bits * share + 6 * (n_bits * share * (1 - share)) ** 0.5) + 1
    apart = F.bit_count(F.col("m1").bitwiseXOR(F.col("m1_l"))) + F.bit_count(F.col("m2").bitwiseXOR(F.col("m2_l")))
    fits = (100 * F.least("size", "size_l") >= percent * F.greatest("size", "size_l")) & (apart <= most)
    pairs = met.join(left, "s").where((F.col("part") != F.col("part_l")) & fits)
    return materialize(pairs.select(F.greatest("part", "part_l").alias("a"), F.least("part", "part_l").alias("b")).distinct(), "candidates")


def prefix_hashes(cut: np.ndarray, tree: int, depth: int) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(r[:depth].tobytes(), seed=tree * 64 + depth) >> 1 for r in cut]


def candidate_links(sigs: DataFrame, orders: list[np.ndarray], hashes: int, depths: tuple[int, ...], region: int, loose: float) -> tuple[DataFrame, DataFrame]:
    """Spanning forests (a, b) of candidates in the regions of all trees, and the classes (rep) that a tree's first depth leaves in a region too large."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sigs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), hashes)
            for t, order in enumerate(orders):
                yield pd.DataFrame({"rep": rows["rep"], "tree": t, "p": prefix_hashes(np.ascontiguousarray(sigs[:, order[: depths[0]]]), t, depths[0])})

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sigs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), hashes)
            for t in np.unique(rows["tree"]):
                at = (rows["tree"] == t).to_numpy()
                cut = np.ascontiguousarray(sigs[at][:, orders[t]])
                made = {f"p{d}": prefix_hashes(cut, int(t), d) for d in depths[1:]}
                tail = [int.from_bytes(r[depths[-1] : depths[-1] + 3].astype(">u2").tobytes(), "big") for r in cut]
                yield pd.DataFrame({"rep": rows["rep"][at], **made, "tail": tail})

    def split(left: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        """Rows in regions of two up to `region`, and rows in larger ones."""
        some = left.join(left.groupBy(p).agg(F.count("*").alias("n")).where("n > 1"), p)
        return some.where(F.col("n") <= region).select(F.col(p).alias("region"), "rep"), some.where(F.col("n") > region).drop("n")

    start = materialize(sigs.mapInPandas(first, "rep long, tree int, p long"), "forest")
    regions, left = split(start, "p")
    names = [f"p{d}" for d in depths[1:]]
    schema = "rep long, " + ", ".join(f"{p} long" for p in names) + ", tail long"
    crowd = materialize(left.select("rep").distinct(), "crowd")
    left = materialize(left.join(sigs, "rep").select("rep", "tree", "sig").mapInPandas(deeper, schema), "forest")
    done = [start, left]
    for p in names:
        if left.isEmpty():
            break
        placed, left = split(left, p)
        regions = regions.unionAll(placed)
        left = materialize(left, "forest")
        done.append(left)
    else:  # regions that no depth cuts: runs of neighbours by the rest of the order, led by the region's first class
        p = names[-1]
        sizes = left.groupBy(p).agg(F.count("*").alias("n"), F.min(F.struct("tail", "rep")).alias("lead")).withColumn("runs", F.ceil(F.col("n") / region).cast("long"))
        runs = left.join(sizes, p)
        spread = F.pmod(F.xxhash64("rep"), F.col("runs"))  # tails of near copies are mostly equal: they are salted as well
        run = F.floor(F.col("tail") / F.lit(float(1 << 48)) * F.col("runs")).cast("long")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))
        own = runs.select(F.xxhash64(p, F.lit("run"), run, spread).alias("region"), "rep")
        salted = runs.select(F.xxhash64(p, F.lit("salt"), spread).alias("region"), "rep")
        lead = sizes.select(p, F.col("lead.rep").alias("rep"), every.alias("r")).select(F.xxhash64(p, F.lit("salt"), F.col("r")).alias("region"), "rep")
        regions = regions.unionAll(own).unionAll(salted.unionAll(lead).distinct())

    def candidates(_: int, rows: pd.DataFrame) -> pd.DataFrame | None:
        if len(rows) < 2:
            return None
        rep = rows["rep"].to_numpy()
        sig = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(rows), hashes)
        least = loose * hashes
        if len(rows) == 2:
            return pd.DataFrame({"a": rep[:1], "b": rep[1:]}) if (sig[0] == sig[1]).sum() >= least else None
        a, b = [], []
        for i in range(len(rows) - 1):
            near = np.nonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least)[0] + i + 1
            a.append(np.full(len(near), i))
            b.append(near)
        root = local_roots(len(rows), np.concatenate(a), np.concatenate(b))
        moved = np.nonzero(root != np.arange(len(rows)))[0]
        return pd.DataFrame({"a": rep[root[moved]], "b": rep[moved]}) if len(moved) else None

    def low_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"rep": rows["rep"], "low": [x[::2] for x in rows["sig"]]})

    full = regions.join(sigs.mapInPandas(low_bytes, "rep long, low binary"), "rep").select("region", "rep", "low")
    made = materialize(by_key(full, "region", ["rep"], candidates, "a long, b long").distinct(), "candidates")
    discard(*done)
    return made, crowd


def shared_counts(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Sizes of the intersections of each of the first n_left sets with all sets: a product of presence rows."""
    if not n_left:
        return np.zeros((0, len(sets)), np.float32)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = list(map(len, sets))
    owner = np.repeat(np.arange(len(sets)), lengths)
    total = np.zeros((n_left, len(sets)), np.float32)
    step = max(64, 8_000_000 // len(sets))
    for lo in range(0, len(values), step):  # presence in slices of the vocabulary: bounded memory
        inside = (at >= lo) & (at < lo + step)
        has = np.zeros((len(sets), min(step, len(values) - lo)), np.float32)
        has[owner[inside], at[inside] - lo] = 1
        total += has[:n_left] @ has.T
    return total


def exact_links(full: DataFrame, percent: int, block: int) -> DataFrame:
    """Spanning forests (a, b) of the exact links inside each candidate group (component, n, node, set).

    Groups of more than `block` classes are cut into blocks. First each block is compared in itself and with two pivots of its group,
    which ties the blocks of near copies together. Then only classes outside a group's largest linked part (guests) are still to be
    compared: they are cut into blocks of their own, and each of these meets every block of the group, so a place holds about two blocks.
    """
    full = full.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    full = materialize(full.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "sets")

    def compare(_: int, rows: pd.DataFrame) -> pd.DataFrame | None:
        asks = np.nonzero(rows["asks"].to_numpy(bool))[0]
        rep = rows["node"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in rows["set"]]
        length = np.array(list(map(len, sets)), float)
        order = np.concatenate([asks, np.setdiff1d(np.arange(len(rep)), asks)])
        shared = shared_counts([sets[i] for i in order], len(asks)).astype(float)
        union = length[asks][:, None] + length[order][None, :] - shared
        i, j = np.nonzero(100 * shared >= percent * union)
        a, b = rep[asks[i]], rep[order[j]]
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(ids), at[: len(a)], at[len(a) :])
        moved = np.nonzero(root != np.arange(len(ids)))[0]
        return pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]}) if len(moved) else None

    large = full.where("blocks > 1")
    rank = F.xxhash64(F.lit(11), "node")
    ends = large.groupBy("component", "blocks").agg(F.min(F.struct(rank, "node")).alias("x"), F.max(F.struct(rank, "node")).alias("y"))
    pivots = ends.select("blocks", "component", F.explode(F.array("x.node", "y.node")).alias("node")).join(full.select("node", "set"), "node")
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = full.unionByName(pivots, allowMissingColumns=True).select(F.xxhash64("component", "block").alias("key"), "node", "set", F.lit(True).alias("asks"))
    links = materialize(by_key(first, "key", ["node"], compare, "a long, b long"), "links")
    if large.isEmpty():
        discard(full)
        return links
    inside = materialize(components(links), "parts")
    parts = large.join(inside, large["node"] == inside["node"], "left").select(large["*"], F.coalesce(inside["component"], large["node"]).alias("part"))
    parts = materialize(parts, "parts")
    tops = parts.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("top"))
    asked = parts.join(tops, "component").withColumn("asks", F.col("part") != F.col("top"))
    rest = asked.where("asks").groupBy("component").agg(F.ceil(F.count("*") / block).cast("long").alias("guests"))
    met = asked.join(rest, "component")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hosts = met.withColumn("table", every("guests")).withColumn("asks", F.lit(False))
    guests = met.where("asks").withColumn("table", F.pmod(F.xxhash64(F.lit(12), "node"), F.col("guests"))).withColumn("block", every("blocks"))
    pairs = hosts.unionByName(guests).select(F.xxhash64("component", "block", "table").alias("key"), "node", "set", "asks")
    more = materialize(by_key(pairs, "key", ["node"], compare, "a long, b long"), "links")
    discard(full, inside, parts)
    return links.unionAll(more)
