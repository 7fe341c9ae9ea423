"""Ranked lexical search over K2-treaps of the term-document grid."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

#: A term: a run of ASCII digits, ASCII letters and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: A-Z in lower case, all that separates terms a space.
_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a zero between each two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """A K2-treap (k = 2) over a square grid of 2^bits rows (terms) and columns (documents).

    A node stands for a square that holds points; it keeps the point of the greatest value, and its four quarters hold the others. Nodes
    lie level by level in the order of their squares, so a node's children follow each other: `first` is the first one, `mask` says which quarters have one.
    """

    bits: int
    mask: np.ndarray
    first: np.ndarray
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray, bits: int) -> bytes:
        """The stored form: for each level, which quarters are there, where in its square a node's point lies, and how far its value is below its parent's."""
        key = (_spread(row) << np.uint64(1)) | _spread(col)
        order = np.argsort(key, kind="stable")
        key, value, row, col = key[order], value[order].astype(np.int64), row[order], col[order]
        levels: list[tuple[np.ndarray, ...]] = []
        for level in range(bits + 1):
            if not len(key):
                break
            cell = key >> np.uint64(2 * (bits - level))
            starts = np.concatenate([[0], np.nonzero(cell[1:] != cell[:-1])[0] + 1])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            hits = np.nonzero(value == np.maximum.reduceat(value, starts)[group])[0]
            top = hits[np.concatenate([[True], group[hits][1:] != group[hits][:-1]])]
            levels.append((cell[top], row[top], col[top], value[top]))
            keep = np.ones(len(key), bool)
            keep[top] = False
            key, value, row, col = key[keep], value[keep], row[keep], col[keep]
        out = []
        for level, (cells, rows, cols, values) in enumerate(levels):
            mask = np.zeros(len(cells), np.uint8)
            if level + 1 < len(levels):
                below = levels[level + 1][0]
                np.bitwise_or.at(mask, np.searchsorted(cells, below >> np.uint64(2)), (1 << (below & np.uint64(3))).astype(np.uint8))
            above = values if level == 0 else levels[level - 1][3][np.searchsorted(levels[level - 1][0], cells >> np.uint64(2))] - values
            inside = (1 << (bits - level)) - 1
            out += [mask.tobytes(), (rows & inside).astype("<u4").tobytes(), (cols & inside).astype("<u4").tobytes(), above.astype("<u4").tobytes()]
        head = np.array([bits, len(levels), *(len(x[0]) for x in levels)], "<u4").tobytes()
        return zlib.compress(head + b"".join(out), 1)

    @classmethod
    def load(cls, stored: bytes) -> Treap:
        data = zlib.decompress(stored)
        bits, n_levels = np.frombuffer(data, "<u4", 2).tolist()
        sizes = np.frombuffer(data, "<u4", n_levels, 8).tolist()
        at, base = 8 + 4 * n_levels, 0
        parts: list[tuple[np.ndarray, ...]] = []
        r0 = c0 = np.zeros(1, np.int64)
        value = np.zeros(1, np.int64)
        for level, size in enumerate(sizes):
            mask = np.frombuffer(data, np.uint8, size, at)
            row, col, drop = (np.frombuffer(data, "<u4", size, at + size + 4 * size * i).astype(np.int64) for i in range(3))
            at += 13 * size
            value = drop if level == 0 else value - drop
            n = _ONES[mask]
            first = base + size + np.cumsum(n) - n
            base += size
            parts.append((mask, first, row + r0, col + c0, value))
            owner, quarter = np.repeat(np.arange(size), n), _QUARTERS[np.repeat(mask, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            half = 1 << max(0, bits - level - 1)
            r0, c0, value = r0[owner] + (quarter >> 1) * half, c0[owner] + (quarter & 1) * half, value[owner]
        mask, first, row, col, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
        rest = np.zeros(len(mask), np.int64)
        parents = np.repeat(np.arange(len(mask)), _ONES[mask] if len(mask) else 0)
        if len(parents):
            np.maximum.at(rest, parents, values[1:])
        return cls(bits, mask, first, row, col, values, rest)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Columns and sums of the k greatest weighted sums over these rows that reach `floor` and are above 0; ties at the k-th all included.

        The rows' paths descend together, best document ranges first. A range is a node of a binary tree over the columns; for each row
        it has the square that holds both, if points of that row may be left in it. A range's bound is its greatest sum found so far, and each row's
        weight times the greatest value left. Ranges below the k-th greatest sum go. `at_once` ranges are opened in a step.
        """
        size = 1 << self.bits
        sums = np.zeros(2 * size, np.int64)  # leaves are at size..; inner nodes get the maxima below them
        if not len(self.mask) or not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, term, node = np.ones(len(rows), np.int64), np.arange(len(rows)), np.zeros(len(rows), np.int64)

        def arrive(term: np.ndarray, node: np.ndarray) -> None:
            hit = self.row[node] == rows[term]
            np.add.at(sums, size + self.col[node[hit]], weights[term[hit]] * self.value[node[hit]])

        arrive(term, node)
        while True:
            for level in range(self.bits - 1, -1, -1):
                lo = 1 << level
                np.maximum(sums[2 * lo : 4 * lo : 2], sums[2 * lo + 1 : 4 * lo : 2], out=sums[lo : 2 * lo])
            least = max(floor, 1)
            if k < size:
                least = max(least, int(np.partition(sums[size:], size - k)[size - k]))
            bound = np.bincount(held, weights[term] * self.rest[node], 2 * size)
            ranges = np.nonzero(bound)[0]  # each has a square with points left in it
            bound = bound[ranges] + sums[ranges]
            live = bound >= least
            n_live = int(live.sum())
            if not n_live:
                break
            state = np.zeros(2 * size, np.uint8)  # 1: stays, 2: is opened
            if n_live > at_once:
                best = np.argpartition(-bound, at_once)[:at_once]
                state[ranges[live]] = 1
                state[ranges[best]] = 2
            else:
                state[ranges[live]] = 2
            state = state[held]
            stay, go = state == 1, state == 2
            level = np.frexp(held[go].astype(float))[1] - 1
            bit = (rows[term[go]] >> (self.bits - 1 - level)) & 1
            opened = [(held[stay], term[stay], node[stay])]
            for c in (0, 1):
                quarter = 2 * bit + c
                mask = self.mask[node[go]]
                there = (mask >> quarter) & 1 == 1
                child = self.first[node[go]] + _ONES[mask & ((1 << quarter) - 1)]
                h, t, n = 2 * held[go][there] + c, term[go][there], child[there]
                arrive(t, n)
                more = self.rest[n] > 0
                opened.append((h[more], t[more], n[more]))
            held, term, node = (np.concatenate(x) for x in zip(*opened))
        found = sums[size:]
        least = max(floor, 1, int(np.partition(found, size - k)[size - k]) if k < size else 1)
        cols = np.nonzero(found >= least)[0]
        return cols, found[cols]


_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)
_QUARTERS = np.array([([q for q in range(4) if i >> q & 1] + [0] * 4)[:4] for i in range(16)], np.int64)

INDEX = "docs array<long>, terms array<binary>, dfs array<int>, tree binary"


def corpus_size(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(TERM)), F.lit(0)).cast("long")
    found = df.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return found.docs, found.terms


def index_documents(df: DataFrame, n_docs: int, n_terms: int, key: str = "doc_id", text: str = "text", vocabulary: set[bytes] | None = None, block_docs: int = 8192, block_points: int = 1_000_000) -> DataFrame:
    """An index: one row for each block of documents (INDEX), written to the shared folder.

    A task cuts its documents into blocks of at most block_docs of them, and no more after block_points points (a document and one of its terms), so a
    block fits in memory whatever the table's size; no text is shuffled. In a block, columns are documents by length and rows are terms by
    frequency, so that neighbours have like impacts. With a vocabulary, only its terms have rows (for a set of items that is known: nothing else is
    asked of the grid); else all terms do. Documents without terms are in no block.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids: list, lengths: list[int], counts: list[dict[bytes, int]]) -> dict | None:
        dfs: Counter[bytes] = Counter()
        for c in counts:
            dfs.update(c.keys())
        if not dfs:
            return None
        terms = sorted(dfs, key=lambda t: (-dfs[t], t))
        place = {t: i for i, t in enumerate(terms)}
        order = sorted(range(len(ids)), key=lambda i: lengths[i])
        sizes = np.array([len(counts[i]) for i in order])
        row = np.fromiter((place[t] for i in order for t in counts[i]), np.int64, sizes.sum())
        tf = np.fromiter((x for i in order for x in counts[i].values()), np.int64, sizes.sum())
        n = np.repeat(np.array([lengths[i] for i in order], np.int64), sizes)
        bits = max(1, math.ceil(math.log2(max(len(order), len(terms), 2))))
        tree = Treap.build(row, np.repeat(np.arange(len(order)), sizes), impact(tf, n, n_docs, n_terms), bits)
        return {"docs": [ids[i] for i in order], "terms": terms, "dfs": [dfs[t] for t in terms], "tree": tree}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, counts, points = [], [], [], 0
        asked = shared.value
        for rows in batches:
            for doc, content in zip(rows["key"].array, rows["text"]):
                terms = terms_of(content)
                if not terms:
                    continue
                found = Counter(terms)
                ids.append(None if pd.isna(doc) else int(doc))
                lengths.append(len(terms))
                counts.append(found if asked is None else {t: found[t] for t in found.keys() & asked})
                points += len(counts[-1])
                if len(ids) >= block_docs or points >= block_points:
                    made = block(ids, lengths, counts)
                    if made:
                        yield pd.DataFrame([made])
                    ids, lengths, counts, points = [], [], [], 0
        made = block(ids, lengths, counts) if ids else None
        if made:
            yield pd.DataFrame([made])

    # a null id stays apart from number 0 by an object column
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return materialize(rows.mapInPandas(run, INDEX), "grid")


def search(index: DataFrame, items: DataFrame, n_docs: int, key: str = "item_id", text: str = "text", k: int = 20, items_at_once: int = 4096, blocks_a_task: int = 3) -> DataFrame:
    """For each item its k best documents: item_id, rank, doc_id, score.

    Items are taken items_at_once at a time, which bounds what is sent to the tasks. Weights come from the index's own counts. A task goes
    through its blocks with each item's k best scores so far, returns what may be among the best, and the best of all tasks are ranked.
    An item without terms, or of which no term is in any document, has no rows; items with the same id and repeated items are items of their own.
    """
    spark = items.sparkSession
    named = materialize(items.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")), "items")
    slices = max(1, math.ceil(named.count() / items_at_once))
    index = index.repartition(max(1, math.ceil(index.count() / blocks_a_task)))  # a block is much work in few bytes
    out = None
    for s in range(slices):
        asked = named.where(F.pmod(F.xxhash64("_row"), F.lit(slices)) == s).collect()
        counts = {r["_row"]: Counter(terms_of(r.text)) for r in asked}
        wanted = sorted({t for c in counts.values() for t in c})
        if not wanted:
            continue
        here = spark.createDataFrame(pd.DataFrame({"term": wanted}), "term binary")
        dfs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df")).join(here, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {bytes(r.term): weight(r.df, n_docs) for r in dfs.collect()}
        queries = {q: [(t, weights[t] * c) for t, c in found.items() if t in weights] for q, found in counts.items()}
        found = index.select("docs", "terms", "tree").mapInPandas(_searcher(spark.sparkContext.broadcast(queries), k), "_row long, doc_id long, score long")
        ids = spark.createDataFrame([(r["_row"], r.item_id) for r in asked], "_row long, item_id long")
        found = found.join(F.broadcast(ids), "_row")  # at most items_at_once rows
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("_row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searcher(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for docs, terms, tree in zip(batch["docs"], batch["terms"], batch["tree"]):
                place = {t: i for i, t in enumerate(terms)}
                treap = Treap.load(tree)
                ids = np.array([-1 if d is None or d != d else int(d) for d in docs], np.int64)
                null = np.array([d is None or d != d for d in docs])
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for item, query in shared.value.items():
                    own = [(place[t], w) for t, w in query if t in place and w > 0]
                    if not own:
                        continue
                    top = best.get(item, np.zeros(0, np.int64))
                    rows, weights = np.array(own, np.int64).T
                    cols, scores = treap.best(rows, weights, k, int(top[-1]) if len(top) == k else 0)
                    if not len(cols):
                        continue
                    order = np.lexsort((ids[cols], null[cols], -scores))[:k]
                    out.append((item, cols[order], scores[order]))
                    best[item] = -np.sort(-np.concatenate([top, scores[order]]))[:k]
                if out:
                    cols = np.concatenate([c for _, c, _ in out])
                    made = pd.DataFrame({"_row": np.repeat([i for i, _, _ in out], [len(c) for _, c, _ in out]), "doc_id": pd.array(ids[cols], "Int64"), "score": np.concatenate([s for _, _, s in out])})
                    made.loc[null[cols], "doc_id"] = pd.NA
                    yield made

    return run


def ranked_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 20, max_vocabulary: int = 1_000_000, **options) -> DataFrame:
    """Indexes docs for these items and ranks all of them for each item: item_id, rank (from 1), doc_id, score.

    Scores are integers: a term's weight falls with the documents that hold it, its impact grows with its repeats in a document
    and falls with the document's length. Equal scores stand by ascending doc_id, null last. If the items have more than max_vocabulary
    different terms, the index has rows for all terms. Null or empty texts have no terms; repeated documents count each; empty tables give no rows.
    """
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs, text)
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    vocabulary = items.select(F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("t")).distinct().limit(max_vocabulary + 1).collect()
    asked = {r.t.encode() for r in vocabulary} if len(vocabulary) <= max_vocabulary else None
    index = index_documents(docs, n_docs, n_terms, key, text, asked, **options)
    return search(index, items, n_docs, item_key, item_text, k) if n_docs else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
