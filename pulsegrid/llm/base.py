"""Helpers shared by the corpus operators: words, shared storage, prefix sums, components, grouped maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


#: Folders that materialize() has written and discard() has not deleted yet.
STORED: set[str] = set()

#: What this worker keeps between tasks, by operator.
CACHES: list[dict] = []


def keep_only(cache: dict | None = None) -> None:
    """Empties the caches of other operators: a reused worker holds one operator's at most."""
    for other in CACHES:
        if other is not cache:
            other.clear()
    give_back()


def give_back() -> None:
    """Returns memory that earlier tasks of this worker have freed to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_slices(rows: pd.DataFrame, size: int = 500) -> Iterator[pd.DataFrame]:
    """A batch in slices, so that what is made of it at once stays small."""
    for lo in range(0, len(rows), size):
        yield rows.iloc[lo : lo + size]


def words_of(text: str | None, lower: bool = False) -> list[str]:
    """The words of a text; `lower` lower-cases A-Z only. Null gives none."""
    if not text:
        return []
    return WORD_RE.findall(text.translate(_UPPER) if lower else text)


def n_words(text: Column) -> Column:
    """Number of words as a long; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df that don't clash (case-insensitively) with names that an operator adds."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


#: Rows of two or three longs that may be sent to every task: some 30 MB at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short rows: marked to be sent to the tasks if it has at most so many, else joined as Spark likes."""
    return F.broadcast(df) if df.count() <= rows else df


def shielded(df: DataFrame, used: list[str], *added: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df for an operator that reads the columns `used` and adds others, and what gives its result the names and order of df back.

    Columns that the operator doesn't read bear names meanwhile that no operator uses, so none clashes with an inner one;
    those named like an added one go.
    """
    kept = others(df, *added)
    names = {c: f"in{i}_" for i, c in enumerate(kept) if c not in used}

    def back(made: DataFrame) -> DataFrame:
        known = [c for c in kept if names.get(c, c) in made.columns]
        new = [c for c in made.columns if c not in {names.get(c, c) for c in known}]
        return made.select(*[F.col(names.get(c, c)).alias(c) for c in known], *new)

    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in kept]), back


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a local one where that is unset and all tasks run on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pulsegrid-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs restart from there, not from the source."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    STORED.add(path)
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later step reads."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, *paths: str) -> None:
    for at in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        STORED.discard(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exclusive_offsets(totals: DataFrame, keys: list[str], bucket: str, value: str, fan: int = 1024) -> DataFrame:
    """Adds `base`: the sum of `value` over smaller buckets of the same keys.

    One row for each (keys, bucket) is expected. Sums are taken in two levels of `fan` buckets, so that no window
    holds more than `fan` buckets or one row for each `fan` of them. Keys must not be null.
    """
    rows = totals.withColumn("_block", F.floor(F.col(bucket) / fan).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*keys).orderBy("_block"))), F.lit(0))).drop("_sum")
    inner = F.coalesce(F.sum(value).over(before(Window.partitionBy(*keys, "_block").orderBy(bucket))), F.lit(0))
    return rows.withColumn("_inner", inner).join(blocks, [*keys, "_block"]).withColumn("base", (F.col("_before") + F.col("_inner")).cast("long")).drop("_block", "_inner", "_before")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of an edge list (a, b: long): node, component (its smallest node), for nodes with a link.

    Alternates two contractions until a forest of stars is left. The first ("large star") moves every larger neighbour of a node
    to the smallest node it knows, the second ("small star") does so with the smaller ones; both keep the components. Each round
    is written to the shared folder, in place of the one before. No links reach the driver, which only learns whether a star is still broken.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    live = materialize(pairs, "edges")
    for _ in range(max_rounds):
        both = live.unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        discard(live)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = large.join(low.where("n > 1").drop("n"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        live = materialize(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large)
        twice = live.groupBy("u").count().where("count > 1")
        chained = live.select(F.col("v").alias("u")).distinct().join(live.select("u"), "u", "left_semi")
        if twice.isEmpty() and chained.isEmpty():
            roots = live.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return live.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def by_key(df: DataFrame, key: str, order: list[str], kernel: Callable[[object, pd.DataFrame], pd.DataFrame | None], schema: str, batch: int = 4000) -> DataFrame:
    """Runs kernel(key value, rows) on each key's rows without one Arrow group for each key.

    Rows are dealt by key and sorted; groups are cut from the stream of batches. Keys must have bounded groups.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        n_out = 0

        def close() -> None:
            nonlocal n_out
            rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held.clear()
            made = kernel(rows[key].iat[0], rows)
            if made is not None and len(made):
                out.append(made)
                n_out += len(made)

        for rows in batches:
            if not len(rows):
                continue
            values = rows[key].to_numpy()
            cuts = [0, *(i for i in (values[1:] != values[:-1]).nonzero()[0] + 1), len(rows)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[0][key].iat[0] != values[lo]:
                    close()
                held.append(rows.iloc[lo:hi])
            if n_out >= batch:
                yield pd.concat(out, ignore_index=True)
                out, n_out = [], 0
        if held:
            close()
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
