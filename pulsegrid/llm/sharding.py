"""Sharding by a two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import exclusive_offsets, fresh_path, materialize, others, shielded, utf8_bytes


def _in_hash_order(items: Column, schema: str) -> Column:
    """Items by their hash; rows of one hash by their columns, unless a map is among them, which has no order."""
    if "map<" not in schema:
        return F.sort_array(items)
    return F.array_sort(items, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))


def shuffle_into_shards(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40, seed: int = 17, bucket_bytes: int = 4 << 20, min_buckets: int = 64) -> DataFrame:
    """Shuffles all rows uniformly and deals them into shards whose row counts differ by one at most.

    Pass 1 scatters the records over memory-sized buckets by a seeded hash of key and text; there are as many buckets
    as keep a mean bucket near `bucket_bytes`. Neighbouring buckets (one to 32, by the number of buckets alone) are a partition, that of
    their number, so the result doesn't depend on the cluster's settings. Pass 2 takes each bucket into memory, puts it in
    hash order (so that a rerun sees the same bucket) and permutes it with Spark's shuffle(), a Fisher-Yates seeded by the
    partition's number that goes on from bucket to bucket. A row's place in the whole is its bucket's prefix sum plus its
    place in the bucket; shards are equal cuts of these places, so partitions in order hold each shard in slot order.

    Returns the columns of df with shard int, slot long (gapless from 0 in each shard); columns of df with these names
    are replaced. Null keys and texts are scattered as values of their own; equal texts under different keys spread
    evenly; an empty table gives no rows. Rows equal in both key and text share a bucket (and may swap places if a column holds a map).
    """
    df, back = shielded(df, [key, text], "shard", "slot")
    size = utf8_bytes(F.col(text)) + 16
    n_rows, n_bytes = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n_buckets = max(min_buckets, math.ceil(n_bytes / bucket_bytes))
    together = min(32, max(1, n_buckets // 1000))
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), crc), F.lit(n_buckets)).cast("int").alias("_bucket")
    counts = df.select(bucket).groupBy("_bucket").agg(F.count("*").alias("_n"))
    bases = materialize(exclusive_offsets(counts, [], "_bucket", "_n").select("_bucket", "base"), "bases")
    kept = others(df, "shard", "slot")
    item = F.struct(F.xxhash64(F.lit(seed + 1), F.col(key), crc).alias("h"), F.struct(*kept).alias("row"))
    part = F.floor(F.col("_bucket") / together).cast("int").alias("_part")
    scattered = df.select(bucket, item.alias("_item")).join(bases, "_bucket").select(part, "_bucket", "base", "_item")
    dealt = scattered.repartitionById(math.ceil(n_buckets / together), F.col("_part"))
    filled = dealt.groupBy("_part", "_bucket").agg(F.max("base").alias("base"), F.collect_list("_item").alias("_items")).sortWithinPartitions("_bucket")
    mixed = filled.select("base", F.posexplode(F.shuffle(_in_hash_order(F.col("_items"), df.select(*kept).schema.simpleString()), F.lit(seed))).alias("_at", "_item"))
    total = max(n_rows, 1)
    shard = F.expr(f"cast((base + _at) * {n_shards}L div {total}L as int)")
    placed = mixed.select(*[F.col("_item.row")[c].alias(c) for c in kept], shard.alias("shard"), (F.col("base") + F.col("_at")).alias("_place"))
    first = F.expr(f"(cast(shard as bigint) * {total}L + {n_shards - 1}L) div {n_shards}L")
    return back(placed.withColumn("slot", F.col("_place") - first).drop("_place"))


def write_shards(shards: DataFrame, path: str) -> None:
    """Writes each shard as its own folder (shard=N): files in order of their names hold its rows in slot order."""
    shards.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded_files(df: DataFrame, **options) -> DataFrame:
    """Shuffles df into shards, writes them to a new folder of the shared store and reads them back."""
    path = fresh_path(df.sparkSession, "shards")
    shards = shuffle_into_shards(df, **options)
    write_shards(shards, path)
    return df.sparkSession.read.schema(shards.schema).parquet(path)
