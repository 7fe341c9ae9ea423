"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import exclusive_offsets, materialize, n_words, shielded, small

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of sources: `share` of all sizes dealt by weight, none above `most` times its source's size.

    sizes: source, source_size, one row for each source. Sources in code point order, null last, take the weights in
    turn. The excess of a source that reaches its limit goes to the others by weight until none is above. In the order
    of limit over weight the limited sources come first, so that prefix sums find the level where the rest stops.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", w).withColumn("_limit", F.col("source_size") * most)
    rank = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_limit").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    # over this order the level rises as long as sources are limited and falls after that: its greatest value is the right one
    rows = rows.withColumn("_level", (whole - before) / left).withColumn("_level", F.max("_level").over(Window.partitionBy()))
    limit = F.col("_limit").cast("double")
    return rows.select("source", "source_size", "weight", F.least(limit, F.col("weight") * F.col("_level")).alias("target"))


def draw_of(key: Column, text: Column, seed: int) -> Column:
    """A random 60-bit number from a hash of a row's id and text."""
    digest = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 9, rows_per_bucket: int = 4096, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """For each row of df: _key, _source, size, source_size, target, and taken, the words that the mix takes of it.

    Each row draws a random 60-bit key from a hash of its id and text. Keys are uniform, so their high bits range-partition
    a source evenly, however large it is; in a bucket rows are sorted by key, buckets get their offsets from prefix sums,
    and the source is cut at exactly its target (rounded): the row on the cut gives part of its words. A target above
    the source's size repeats the whole source first. Reruns give the same rows.

    Null text has size 0 and gives nothing; a null source is a source; rows equal in id and text are interchangeable
    and each counts; an empty table gives no rows.
    """
    draw = draw_of(F.col(key), F.col(text), seed)
    slim = materialize(df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"), draw.alias("_draw")), "mix")
    bits = min(40, max(4, math.ceil(math.log2(max(1, slim.count() / rows_per_bucket)))))
    tag = F.when(F.col("_source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("_source")))
    slim = slim.withColumn("_tag", tag).withColumn("_bucket", F.shiftright("_draw", 60 - bits).cast("long"))
    sums = slim.groupBy("_tag", "_source", "_bucket").agg(F.sum("size").alias("_size"))
    bases = exclusive_offsets(sums.select("_tag", "_bucket", "_size"), ["_tag"], "_bucket", "_size").select("_tag", "_bucket", "base")
    sources = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sources, weights, share, most).withColumnRenamed("source", "_source").withColumn("_tag", tag)
    inner = Window.partitionBy("_tag", "_bucket").orderBy("_draw", "_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("_end", F.sum("size").over(inner)).join(bases, ["_tag", "_bucket"]).join(targets.drop("_source", "weight"), "_tag")
    start = F.col("base") + F.col("_end") - F.col("size")
    cut = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(cut / F.col("source_size"))).otherwise(0).cast("long")
    rest = cut - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select("_key", "_source", "_draw", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of df, each as often as the mix takes it, with the columns of df.

    Documents stay whole: the one on a source's cut is taken if at least half of its words are, so that a source ends
    within half a document of its target. Rows without words give nothing. Rows equal in id, source and text are interchangeable: they are
    numbered, and the first of them give one copy more than the others where their copies don't divide evenly.
    """
    df, back = shielded(df, [key, text, source])
    taken = mix_sources(df, key, text, source, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    sums = taken.groupBy("_key", "_source", "_draw").agg(F.sum(copies).alias("_copies"), F.count("*").alias("_rows"))
    sums = small(materialize(sums.where("_copies > 0"), "copies"))
    on = F.col(key).eqNullSafe(F.col("_key")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_d") == F.col("_draw"))
    joined = df.withColumn("_d", draw_of(F.col(key), F.col(text), options.get("seed", 9))).join(sums, on)
    alone = joined.where("_rows = 1").withColumn("_turns", F.col("_copies"))
    at = F.row_number().over(Window.partitionBy("_key", "_source", "_draw").orderBy("_draw"))
    equal = joined.where("_rows > 1").withColumn("_at", at)  # rows with equals only
    equal = equal.withColumn("_turns", F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_at") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)).drop("_at")
    both = alone.unionByName(equal).where("_turns > 0")
    return back(both.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_turns").cast("int"))).alias("_turn")).drop("_turn"))
