"""State machine over polls: streaks, thresholds, status, flaps, site state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch
from ..functions.folds import scan
from ..sources.storage import with_checkpoints


def streaks(df: DataFrame, key: str, ok: str, order: list[str]) -> DataFrame:
    """Length so far of the run of equal `ok` values at each row: fails or oks in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    flip = F.coalesce((F.col(ok) != F.lag(ok).over(w)).cast("int"), F.lit(0))
    rows = df.withColumn("_run", F.sum(flip).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order))
    return rows.withColumn("fails", F.when(~F.col(ok), n).otherwise(0)).withColumn("oks", F.when(F.col(ok), n).otherwise(0)).drop("_run")


@dataclass
class Threshold:
    """On after `cycles` values at or above enter, off at or below leave; between the two the count is held."""

    enter: float
    leave: float
    cycles: int
    run: int = 0
    on: bool = False

    def step(self, v: float | None) -> bool:
        if v is None or v != v:
            return self.on
        if v >= self.enter:
            self.run = min(self.run + 1, self.cycles)
            self.on = self.on or self.run >= self.cycles
        elif v <= self.leave:
            self.run, self.on = 0, False
        return self.on


@dataclass
class Status:
    """Status after each poll, unknown before the first answer.

    maintenance; else down after `down_after` silent polls, or unreachable if the upstream device is down itself; a silence not yet
    confirmed keeps the status (unknown stays, maintenance becomes up); down and unreachable end with the second good
    poll; degraded; up.
    """

    down_after: int = 3
    status: str = "unknown"
    fails: int = 0
    oks: int = 0

    def step(self, reachable: bool, degraded: bool, maintenance: bool, upstream_down: bool = False) -> str:
        self.fails, self.oks = (0, self.oks + 1) if reachable else (self.fails + 1, 0)
        if maintenance:
            self.status = "maintenance"
        elif self.fails >= self.down_after:
            self.status = "unreachable" if upstream_down else "down"
        elif not reachable:
            self.status = "up" if self.status == "maintenance" else self.status
        elif self.oks >= 2 or self.status not in ("down", "unreachable"):
            self.status = "degraded" if degraded else "up"
        return self.status


def thresholds(df: DataFrame, key: str, value: str, order: list[str], enter: float, leave: float, cycles: int) -> DataFrame:
    """`on` for each row of a key in order: at least `cycles` values at or above enter since the last one at or below leave."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(~F.isnan(value), F.col(value))
    rows = df.withColumn("_leaves", F.sum(F.coalesce((v <= leave) & (v < enter), F.lit(False)).cast("int")).over(w)).withColumn("_enters", F.coalesce(v >= enter, F.lit(False)).cast("int"))
    since = Window.partitionBy(key, "_leaves").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("on", F.sum("_enters").over(since) >= cycles).drop("_leaves", "_enters")


def device_status(df: DataFrame, key: str, order: list[str], down_after: int = 3) -> DataFrame:
    """`status` after each poll (reachable, degraded, maintenance, upstream_down) of a device."""
    return scan(df, [key], order, ["reachable", "degraded", "maintenance", "upstream_down"], lambda: Status(down_after).step, "status string")


def status_over_time(polls: DataFrame, parents: DataFrame, down_after: int = 3) -> DataFrame:
    """`status` and `cause` after each poll (device_id, ts, sample_id, reachable, degraded, maintenance), the upstream device's own status at that time taken from its polls.

    A failed device is unreachable, with its parent (device_id, parent) as cause, if the parent has failed by its last poll before; else it is down.
    Whether a device has failed depends on its own polls alone (down and unreachable end alike), so one fold gives it for all
    devices, and each device's polls then meet the moments at which its parent failed or recovered in one sorted pass, however deep the tree.
    Polls stand in order of ts and sample_id.
    """
    order = ["ts", "sample_id"]
    own = device_status(polls.withColumn("upstream_down", F.lit(False)), "device_id", order, down_after).drop("upstream_down")
    flips = own.withColumn("_failed", F.col("status") == "down").withColumn("_was", F.lag("_failed", 1, False).over(Window.partitionBy("device_id").orderBy(*order)))
    flips = flips.where("_failed <> _was").select(F.col("device_id").alias("parent"), "ts", "sample_id", "_failed")
    seen = parents.where("parent is not null").select("device_id", "parent").join(flips, "parent").select("device_id", "ts", "sample_id", F.lit(0).alias("_kind"), "parent", "_failed")
    rows = own.withColumn("_kind", F.lit(1)).unionByName(seen, allowMissingColumns=True)
    now = F.last(F.when(F.col("_kind") == 0, F.struct("_failed", "parent")), ignorenulls=True).over(Window.partitionBy("device_id").orderBy(*order, "_kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_now", now).where("_kind = 1")
    under = (F.col("status") == "down") & F.coalesce(F.col("_now._failed"), F.lit(False))
    return rows.select(*own.drop("status").columns, F.when(under, "unreachable").otherwise(F.col("status")).alias("status"), F.when(under, F.col("_now.parent")).alias("cause"))


def folded_over_time(statuses: DataFrame, parents: DataFrame) -> DataFrame:
    """device_id, ts, sample_id, cause: devices that are down when their parent goes down (its poll sample_id at ts), and so turn unreachable before their own next poll."""
    w = Window.partitionBy("device_id").orderBy("ts", "sample_id")
    rows = statuses.select("device_id", "ts", "sample_id", "status", F.lag("status", 1, "unknown").over(w).alias("_was"))
    fell = rows.where("status = 'down' and _was <> 'down'").select(F.col("device_id").alias("parent"), "ts", "sample_id")
    fell = parents.where("parent is not null").select("device_id", "parent").join(fell, "parent")
    both = rows.select("device_id", "ts", "sample_id", "status", F.lit(None).cast("long").alias("parent")).unionByName(fell.select("device_id", "ts", "sample_id", F.lit(None).cast("string").alias("status"), "parent"))
    before = Window.partitionBy("device_id").orderBy("ts", "sample_id", F.col("parent").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_s", F.last("status", ignorenulls=True).over(before)).where("parent is not null and _s = 'down'").select("device_id", "ts", "sample_id", F.col("parent").alias("cause"))


def interface_timeline(samples: DataFrame, events: DataFrame, devices: DataFrame, util: tuple[float, float, int] = (85.0, 70.0, 5), errors: tuple[float, float, int] = (1.0, 0.1, 3)) -> DataFrame:
    """device_id, if_index, ts, seq, kind (sample or event), status: an interface's status after each of its samples and link events.

    samples: ts, seq, admin_up, oper_up, util and err_rate (null without rates), important; events: ts, seq, up; devices: ts, seq, status of the whole device from then on.
    A link event moves the interface at once. A sample gives unknown if the device is down or unreachable by then, maintenance if it is in
    maintenance, unknown if the port is administratively down, else down or up; an important port that is up is degraded while its utilisation
    or errors are over their thresholds (enter, leave, cycles; counted on samples that show it up with rates). At the same
    ts the device comes first, then the sample, then the event; then seq counts.
    """
    rows = samples.select("device_id", "if_index", "ts", "seq", F.lit(1).alias("_kind"), "admin_up", "oper_up", "util", "err_rate", "important")
    rows = rows.unionByName(events.select("device_id", "if_index", "ts", "seq", F.lit(2).alias("_kind"), F.col("up").alias("oper_up")), allowMissingColumns=True)
    rows = rows.unionByName(devices.select("device_id", "ts", "seq", F.lit(0).alias("_kind"), F.col("status").alias("_device")), allowMissingColumns=True)
    order = ["ts", "_kind", "seq"]
    rows = rows.withColumn("_device", F.last("_device", ignorenulls=True).over(Window.partitionBy("device_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where("_kind > 0")
    plain = F.when(F.col("oper_up"), "up").otherwise("down")
    sampled = F.when(F.col("_device").isin("down", "unreachable"), "unknown").when(F.col("_device") == "maintenance", "maintenance").when(~F.col("admin_up"), "unknown").otherwise(plain)
    rows = rows.withColumn("status", F.when(F.col("_kind") == 2, plain).otherwise(sampled))
    counted = (F.col("_kind") == 1) & (F.col("status") == "up") & F.col("important")
    rows = rows.withColumn("_key", F.struct("device_id", "if_index"))
    over = F.lit(False)
    for name, (enter, leave, cycles) in (("util", util), ("err_rate", errors)):
        rows = thresholds(rows.withColumn("_v", F.when(counted, F.col(name))), "_key", "_v", order, enter, leave, cycles).withColumnRenamed("on", f"_{name}").drop("_v")
        over = over | (F.col(f"_{name}") & F.col(name).isNotNull())
    status = F.when(counted & over, "degraded").otherwise(F.col("status"))
    return rows.select("device_id", "if_index", "ts", "seq", F.when(F.col("_kind") == 1, "sample").otherwise("event").alias("kind"), status.alias("status"))


def silent_agents(df: DataFrame, cycles: int = 3) -> DataFrame:
    """Polls at which ping has worked and the agent been silent for `cycles` in a row."""
    rows = df.withColumn("quiet", F.col("reachable") & ~F.col("snmp_ok"))
    return streaks(rows, "device_id", "quiet", ["ts", "sample_id"]).where(F.col("oks") >= cycles).select("device_id", "sample_id", F.col("oks").alias("run"))


def suppressed(status: DataFrame, parents: DataFrame) -> DataFrame:
    """down turns to unreachable, with the topmost failed device as cause, where the upstream device is down or unreachable.

    status: device_id, status; parents: device_id, parent. Each round doubles the distance that causes travel, up to the number of failed devices.
    """
    with_checkpoints(status.sparkSession)
    down = status.where("status = 'down'").select("device_id").checkpoint()
    up = down.join(parents, "device_id").join(down.select(F.col("device_id").alias("parent")), "parent").select("device_id", F.col("parent").alias("cause"))
    hops = down.join(up, "device_id", "left").select("device_id", F.coalesce("cause", "device_id").alias("cause")).checkpoint()
    for _ in range(down.count().bit_length()):
        onward = hops.select(F.col("device_id").alias("cause"), F.col("cause").alias("next"))
        hops = hops.join(onward, "cause").select("device_id", F.col("next").alias("cause")).checkpoint()
    out = status.join(hops, "device_id", "left")
    moved = F.col("cause").isNotNull() & (F.col("cause") != F.col("device_id"))
    return out.select("device_id", F.when(moved, "unreachable").otherwise(F.col("status")).alias("status"), F.when(moved, F.col("cause")).alias("cause"))


def transitions(df: DataFrame, key: str, order: list[str], span: int = 600, most: int = 5) -> DataFrame:
    """Status changes (unknown left out), and whether more than `most` of them lie in the last `span` seconds."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.where("status <> 'unknown'").withColumn("previous", F.lag("status").over(w)).where("previous <> status")
    micros = (F.col("ts").cast("timestamp").cast("double") * 1_000_000).cast("long")
    recent = Window.partitionBy(key).orderBy("_us").rangeBetween(-(span * 1_000_000 - 1), 0)
    return rows.withColumn("_us", micros).withColumn("changes", F.count("*").over(recent)).withColumn("flapping", F.col("changes") > most).drop("_us")


def interface_status(df: DataFrame, devices: DataFrame) -> DataFrame:
    """unknown where the device is down or unreachable, maintenance where it is in maintenance, unknown if the port is administratively down, else down or up.

    The device's state wins over the port's own; a device without a state decides nothing.
    """
    rows = df.join(devices.select("device_id", F.col("status").alias("device_status")), "device_id", "left")
    made = F.when(F.col("device_status").isin("down", "unreachable"), "unknown").when(F.col("device_status") == "maintenance", "maintenance").when(~F.col("admin_up"), "unknown").when(F.col("oper_up"), "up").otherwise("down")
    return rows.withColumn("status", made).drop("device_status")


def latest_evidence(samples: DataFrame, events: DataFrame) -> DataFrame:
    """State of each object after the newest of its polls and link events; an event moves it at once and wins a tie."""
    rows = samples.select("object", "ts", "up", F.lit(0).alias("kind")).unionByName(events.select("object", "ts", "up", F.lit(1).alias("kind")))
    return rows.groupBy("object").agg(F.max_by("up", F.struct("ts", "kind", "up")).alias("up"), F.max("ts").alias("since"))


def sliding_count(df: DataFrame, key: str, span: int, least: int) -> DataFrame:
    """Rows at which a key has had `least` or more rows in the last `span` seconds (a row exactly so old doesn't count)."""
    micros = (F.col("ts").cast("timestamp").cast("double") * 1_000_000).cast("long")
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-(span * 1_000_000 - 1), 0)
    return df.withColumn("_us", micros).withColumn("recent", F.count("*").over(w)).where(F.col("recent") >= least).drop("_us")


def sites_down(devices: DataFrame, least: int = 3, percent: float = 80) -> DataFrame:
    """Sites of `least` or more monitored devices of which `percent` or more are down or unreachable."""
    bad = F.sum(F.col("status").isin("down", "unreachable").cast("int"))
    rows = devices.where("monitored").groupBy("site_id").agg(F.count("*").alias("devices"), bad.alias("bad"))
    return rows.where((F.col("devices") >= least) & (F.col("bad") * 100 >= F.col("devices") * percent))


def stale_devices(polls: DataFrame, devices: DataFrame, now: int, interval: int, cycles: int = 5) -> DataFrame:
    """Monitored devices (device_id, monitored, status) not yet unknown without a poll for `cycles` intervals; one that was never polled isn't stale."""
    last = polls.groupBy("device_id").agg(F.max(epoch(F.col("ts"))).alias("last_poll"))
    last = last.join(devices.where("monitored and status <> 'unknown'").select("device_id"), "device_id", "left_semi")
    return last.where(F.lit(now) - F.col("last_poll") > cycles * interval).withColumn("status", F.lit("unknown"))


def under_maintenance(df: DataFrame, windows: DataFrame, day: int = 86400) -> DataFrame:
    """Rows (device_id, site_id, ts) that a window covers, both ends included: a device's own window, its site's, or one for all.

    Windows are cut into the days they touch, so that the join is on day and scope and the time test is a filter.
    """
    scope = F.when(F.col("w_device").isNotNull(), F.concat(F.lit("d"), F.col("w_device").cast("string"))).when(F.col("w_site").isNotNull(), F.concat(F.lit("s"), F.col("w_site").cast("string"))).otherwise("all")
    days = F.explode(F.sequence(F.floor(epoch(F.col("from_ts")) / day), F.floor(epoch(F.col("to_ts")) / day)))
    w = windows.select("from_ts", "to_ts", F.col("device_id").alias("w_device"), F.col("site_id").alias("w_site")).select("from_ts", "to_ts", scope.alias("scope"), days.alias("day"))
    scopes = F.array(F.concat(F.lit("d"), F.col("device_id").cast("string")), F.concat(F.lit("s"), F.col("site_id").cast("string")), F.lit("all"))
    rows = df.select("*", F.floor(epoch(F.col("ts")) / day).alias("day"), F.explode(scopes).alias("scope"))
    hit = rows.join(w, (rows["scope"] == w["scope"]) & (rows["day"] == w["day"]) & (rows["ts"] >= w["from_ts"]) & (rows["ts"] <= w["to_ts"]), "left_semi")
    return hit.drop("day", "scope").distinct()
