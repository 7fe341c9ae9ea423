"""Metric series: append rules, rollups, tiers, rates and statistics (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, epoch
from ..functions.folds import Gap, scan


def accept_samples(df: DataFrame, series: list[str], chunk: int = 50_000, fan: int = 1000) -> DataFrame:
    """Rows (series, t seconds, arrival, v) that an append-only store keeps.

    NaN and infinite values go, but their times count as arrivals; a row older than the hour of the newest earlier arrival of any series goes, and one older
    than its series' newest; of equal times the last arrival stays. The running maximum over all arrivals is
    taken in three levels: inside chunks of arrivals, over the chunks of a block of `fan`, and over the blocks. Chunks and
    blocks join as equals; Spark broadcasts their maxima while these are small.
    """
    rows = df.withColumn("_chunk", F.floor(F.col("arrival") / chunk)).withColumn("_block", F.floor(F.col("_chunk") / fan))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_block", "_chunk").agg(F.max("t").alias("_top"))
    blocks = tops.groupBy("_block").agg(F.max("_top").alias("_b")).withColumn("_before", F.max("_b").over(before(Window.orderBy("_block")))).drop("_b")
    tops = tops.withColumn("_inside", F.max("_top").over(before(Window.partitionBy("_block").orderBy("_chunk")))).join(blocks, "_block").select("_chunk", F.greatest("_inside", "_before").alias("_earlier"))
    rows = rows.drop("_block").join(tops, "_chunk")
    newest = F.greatest(F.col("_earlier"), F.max("t").over(before(Window.partitionBy("_chunk").orderBy("arrival"))))
    rows = rows.withColumn("_head", F.floor(newest / 3600) * 3600).where(F.col("_head").isNull() | (F.col("t") >= F.col("_head")))
    rows = rows.where(~F.isnan("v") & (F.abs("v") != float("inf")))
    own = F.max("t").over(before(Window.partitionBy(*series).orderBy("arrival")))
    rows = rows.withColumn("_own", own).where(F.col("_own").isNull() | (F.col("t") >= F.col("_own")))
    return rows.groupBy(*series, "t").agg(F.max_by("v", "arrival").alias("v"))


def rollup(df: DataFrame, series: list[str], seconds: int = 300) -> DataFrame:
    """avg, min and max of each series in each bucket."""
    return df.groupBy(*series, bucket(F.col("ts"), seconds).alias("t")).agg(F.round(F.avg("v"), 6).alias("v"), F.min("v").alias("min"), F.max("v").alias("max"))


def merge_rollup(fresh: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """A fresh bucket replaces a stored one; others stay as they are."""
    return fresh.unionByName(stored.join(fresh.select(*keys), keys, "left_anti"))


def tiered_range(raw: DataFrame, rolled: DataFrame, start: int, stop: int, cut: int) -> DataFrame:
    """Points in [start, stop]: rollup before the day-aligned cut, raw from it on (min and max are the value)."""
    cut -= cut % 86400
    new = raw.where((F.col("t") >= max(start, cut)) & (F.col("t") <= stop)).withColumns({"min": F.col("v"), "max": F.col("v"), "tier": F.lit("raw")})
    old = rolled.where((F.col("t") >= start) & (F.col("t") <= stop) & (F.col("t") < cut)).withColumn("tier", F.lit("rollup"))
    return old.unionByName(new)


def fetch_series(df: DataFrame, names: list[str], start: int | None, now: int, retention: int, most: int = 40) -> DataFrame:
    """Points of at most `most` series since start (24 hours by default), not before the retention's begin."""
    start = max(now - 86400 if start is None else start, now - retention)
    return df.where(F.col("series").isin(names[:most]) & (F.col("t") >= start) & (F.col("t") <= now))


def counter_rate(value: Column, order: Window, bits: int, scale: int = 1) -> Column:
    """Per-second rate of a counter from the row before: null on a first row, under one second, or if the device's uptime fell since; a 32-bit decrease is a wrap, a 64-bit one 0."""
    prev, dt = F.lag(value).over(order), epoch(F.col("ts")) - F.lag(epoch(F.col("ts"))).over(order)
    wrapped = F.lit(4294967295) - prev + value + 1 if bits == 32 else F.lit(0)
    delta = F.when(value >= prev, value - prev).otherwise(wrapped)
    rebooted = F.coalesce(F.col("uptime") < F.lag("uptime").over(order), F.lit(False))
    return F.when(prev.isNotNull() & (dt >= 1) & ~rebooted, F.round(delta * scale / dt, 6))


def counters_to_rates(df: DataFrame) -> DataFrame:
    """Rates of interface counters: in bits per second from both counter widths, errors per second (32-bit). Without a column uptime no reboot is known."""
    df = df if "uptime" in df.columns else df.withColumn("uptime", F.lit(None).cast("long"))
    w = Window.partitionBy("device_id", "if_index").orderBy("ts")
    return df.select("device_id", "if_index", "ts", counter_rate(F.col("in_oct32"), w, 32, 8).alias("bps32"), counter_rate(F.col("in_oct64"), w, 64, 8).alias("bps64"), counter_rate(F.col("in_err"), w, 32).alias("err_rate"))


def utilisation(bps: Column, speed_mbps: Column) -> Column:
    """Percent of the speed; 0 where the speed isn't known."""
    return F.when(speed_mbps > 0, bps / (speed_mbps * 1_000_000) * 100).otherwise(0.0)


def thin_history(df: DataFrame, keys: list[str], order: list[str], gap: int = 300) -> DataFrame:
    """Important ports keep every row, others one at least `gap` seconds after the last one kept.

    The choice depends on the last kept row, so each port's rows (t in seconds, important) are folded in order.
    """
    rows = scan(df, keys, ["t", *order], ["t", "important"], lambda: Gap(gap).step, "_keep boolean")
    return rows.where("_keep").drop("_keep")


def kept_series(df: DataFrame, keys: list[str]) -> DataFrame:
    """Series of thinned interface rows (important, and rates in_bps, out_bps, in_err, out_err, in_drop, out_drop, in_pps, out_pps): keys, t, series, v.

    Bit rates are always kept; errors and drops, both directions, only where one of the two is above zero; packet rates only of important ports.
    """
    pair = lambda name, when: [F.when(when, F.struct(F.lit(f"if_{d}_{name}").alias("series"), F.col(f"{d}_{name}").cast("double").alias("v"))) for d in ("in", "out")]
    some = lambda name: (F.col(f"in_{name}") > 0) | (F.col(f"out_{name}") > 0)
    made = F.array(*pair("bps", F.lit(True)), *pair("err", some("err")), *pair("drop", some("drop")), *pair("pps", F.col("important")))
    return df.select(*keys, "t", F.inline(F.array_compact(made)))


def reboots(df: DataFrame) -> DataFrame:
    """Rows whose uptime fell by more than 5 s below a positive one and is under a day."""
    prev = F.lag("uptime").over(Window.partitionBy("device_id").orderBy("ts", "sample_id"))
    return df.withColumn("prev_uptime", prev).where((F.col("prev_uptime") > 0) & (F.col("uptime") < F.col("prev_uptime") - 5) & (F.col("uptime") < 86400))


def series_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, and the peak of values and bucket maxima."""
    return df.groupBy(*keys).agg(F.round(F.avg("v"), 6).alias("mean"), F.max(F.greatest("v", "max")).alias("peak"))


def profile_metrics(values: DataFrame, profile: DataFrame) -> DataFrame:
    """Values (device_id, metric, at, v) scaled and aggregated (avg, max, sum or first) as the small profile table (metric, scale, how) says."""
    rows = values.join(F.broadcast(profile), "metric").withColumn("v", F.col("v") * F.col("scale"))
    made = F.when(F.col("how") == "avg", F.avg("v")).when(F.col("how") == "max", F.max("v")).when(F.col("how") == "sum", F.sum("v")).otherwise(F.min_by("v", "at"))
    return rows.groupBy("device_id", "metric", "how").agg(made.alias("value"))


def load_percent(df: DataFrame) -> DataFrame:
    """cpu_pct: the ALL row of a device if it has one, else the mean of its CPUs; mem_pct: used / (used + free), else a percentage as given, else used (or else reserved) over physical."""
    cpu = F.coalesce(F.max(F.when(F.col("cpu") == "ALL", F.col("cpu_v"))), F.avg(F.when(F.col("cpu") != "ALL", F.col("cpu_v"))))
    part = lambda a, b: F.when(b > 0, a / b * 100)
    used, free = F.max("used"), F.max("free")
    mem = F.coalesce(part(used, used + free), F.max("mem_given"), part(F.coalesce(F.max("used"), F.max("reserved")), F.max("physical")))
    return df.groupBy("device_id").agg(F.round(cpu, 6).alias("cpu_pct"), F.round(mem, 6).alias("mem_pct"))


def echo_statistics(df: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """Loss, min, avg, max and jitter (mean step between successive replies) of each echo run, from one row for each request (reachable, rtt_ms)."""
    w = Window.partitionBy(*run).orderBy(*order)
    replies = df.where("reachable").withColumn("_step", F.abs(F.col("rtt_ms") - F.lag("rtt_ms").over(w)))
    sent = df.groupBy(*run).agg(F.count("*").alias("sent"))
    got = replies.groupBy(*run).agg(F.count("*").alias("got"), F.min("rtt_ms").alias("min_ms"), F.max("rtt_ms").alias("max_ms"), F.round(F.avg("rtt_ms"), 6).alias("avg_ms"), F.round(F.avg("_step"), 6).alias("jitter_ms"))
    rows = sent.join(got, run, "left")
    loss = F.round((F.col("sent") - F.coalesce("got", F.lit(0))) / F.col("sent") * 100.0, 6)
    return rows.select(*run, loss.alias("loss_pct"), "min_ms", "max_ms", "avg_ms", F.coalesce("jitter_ms", F.lit(0.0)).alias("jitter_ms"))


def samples_to_series(df: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """One row for each known metric of a wide sample: series `metric|object`, ts, v."""
    return df.unpivot([key, "ts"], metrics, "metric", "v").where(F.col("v").isNotNull()).select(F.concat_ws("|", "metric", F.col(key).cast("string")).alias("series"), "ts", "v")
