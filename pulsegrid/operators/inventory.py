"""Inventory and overview (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rank


def device_list(devices: DataFrame, site: int | None = None, status: str | None = None, role: str | None = None, text: str | None = None) -> DataFrame:
    """Devices by site, status and role, and by a part of name, address, role, status or id."""
    rows = devices
    for c, v in (("site_id", site), ("status", status), ("role", role)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    if text:
        rows = rows.where(F.lower(F.concat_ws(" ", "name", "ip", "role", "status", F.col("device_id").cast("string"))).contains(text.lower()))
    return rows


def match_profile(devices: DataFrame, profiles: DataFrame) -> DataFrame:
    """The best vendor profile of each device: highest priority, then its longest object-id prefix at a dot; a match of the description adds 1000.

    profiles: profile, priority, prefix, pattern; a table of the product, sent to every task. The prefixes of a device's id
    are spelled out, so that they meet profiles by equality; patterns are few and tried as columns.
    """
    oid = F.regexp_replace("oid", r"^\.", "")
    parts = F.split(oid, r"\.")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    by_id = devices.select("device_id", F.explode(cut).alias("prefix")).join(F.broadcast(profiles.select("profile", "priority", "prefix")), "prefix").select("device_id", "profile", "priority", F.length("prefix").alias("n"), F.lit(0).alias("more"))
    patterns = profiles.where("pattern is not null").select("profile", "priority", "pattern").collect()  # the product's own list
    tests = [F.when(F.col("descr").rlike(r["pattern"]), F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["priority"]).alias("priority"))) for r in patterns]
    rows = by_id
    if tests:
        hits = devices.select("device_id", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("device_id", "x.*", F.lit(0).alias("n"), F.lit(1000).alias("more"))
        rows = by_id.unionByName(hits)
    total = rows.groupBy("device_id", "profile", "priority").agg((F.max("n") + F.max("more")).alias("n"))
    best = total.groupBy("device_id").agg(F.max_by("profile", F.struct("priority", "n", "profile")).alias("profile"))
    return devices.select("device_id").join(best, "device_id", "left").select("device_id", F.coalesce("profile", F.lit("generic")).alias("profile"))


def os_version(descr: Column) -> Column:
    """The text after the first `Version `, `version ` or `v` up to a comma, blank or line end, if it has 3 to 30 signs and starts with a digit."""
    out = []
    for key in ("Version ", "version ", "v"):
        v = F.regexp_extract(descr, f"{key}([^, \n]*)", 1)
        out.append(F.when(F.length(v).between(3, 30) & v.rlike("^[0-9]"), v))
    return F.coalesce(*out, F.lit(""))


#: Interface kinds by type number.
KINDS = {6: "phys", 117: "phys", 0: "phys", 161: "lag", 53: "vlan", 135: "vlan", 136: "vlan", 131: "tunnel", 150: "tunnel", 24: "loopback"}


def interface_kind(if_type: Column, name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[if_type.cast("int")]
    skip = F.when((if_type == 1) & F.lower(name).rlike("^(null|stack)"), "skip")
    return F.coalesce(skip, known, F.lit("other"))


#: A decimal number of an address, without leading zeros.
_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def expand_addresses(specs: DataFrame, limit: int = 4096) -> DataFrame:
    """spec, ip, error: the addresses of `a.b.c.d/n` (without network and broadcast, if it has more than two), `a-b`, `a.b.c.d-n` (n in place of d) and single ones.

    A network of more than `limit` addresses is refused, a range gives its first `limit` ones. What can't be read gives one row with an
    error and no address, and nothing else fails; a range that ends before it begins gives none.
    """
    number = lambda ip: F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, p: n * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    valid = lambda ip: F.coalesce(ip.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$"), F.lit(False))
    s = F.trim("spec")
    slash, dash = F.contains(s, F.lit("/")), F.contains(s, F.lit("-"))
    first, last = F.trim(F.substring_index(s, "-", 1)), F.trim(F.expr("substring(trim(spec), instr(trim(spec), '-') + 1)"))
    short = ~F.contains(last, F.lit("."))
    last = F.when(short, F.concat_ws(".", F.substring_index(first, ".", 3), last)).otherwise(last)
    net, bits = F.substring_index(s, "/", 1), F.substring_index(s, "/", -1).try_cast("int")
    error = (
        F.when(slash & ~(valid(net) & F.coalesce(bits.between(0, 32), F.lit(False))), "not a network").when(slash & (F.pow(F.lit(2), 32 - bits) > limit), "network too large")
        .when(~slash & dash & ~valid(first), "bad range").when(~slash & dash & ~valid(last), "bad range end").when(~slash & ~dash & ~valid(s), "not an address")
    )
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    base, edge = F.floor(number(net) / size) * size, F.when(size > 2, 1).otherwise(0)
    low = F.when(slash, base + edge).when(dash, number(first)).otherwise(number(s))
    high = F.when(slash, base + size - 1 - edge).when(dash, F.least(number(last), number(first) + limit - 1)).otherwise(number(s))
    rows = specs.withColumn("error", F.when(F.col("spec").isNull(), "not an address").otherwise(error)).withColumns({"_lo": low.cast("long"), "_hi": high.cast("long")})
    n = F.col("n")
    byte = lambda k: F.pmod(F.floor(n / 256**k), F.lit(256)).cast("string")
    good = rows.where("error is null and _hi >= _lo").select("spec", F.explode(F.sequence("_lo", "_hi")).alias("n")).select("spec", F.concat_ws(".", byte(3), byte(2), byte(1), byte(0)).alias("ip"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(rows.where("error is not null").select("spec", F.lit(None).cast("string").alias("ip"), "error"))


def register(found: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """New devices by address, in order of first sight; those beyond the cap aren't monitored. Known addresses don't register again."""
    new = found.groupBy("ip").agg(F.min("seen").alias("seen")).join(known.select("ip"), "ip", "left_anti")
    free = max(0, cap - known.count())
    edge = new.select("seen", "ip").orderBy("seen", "ip").limit(free).agg(F.max(F.struct("seen", "ip")).alias("edge"))  # one row
    return new.join(F.broadcast(edge), F.lit(True)).select("ip", "seen", F.coalesce(F.struct("seen", "ip") <= F.col("edge"), F.lit(False)).alias("monitored"))


def capacity(devices: DataFrame, cap: int) -> DataFrame:
    """The oldest devices keep their monitoring slots: all of those created before the cap-th, and those of its time by id."""
    edge = devices.select("created", "device_id").orderBy("created", "device_id").limit(cap).agg(F.max(F.struct("created", "device_id")).alias("edge"))
    return devices.join(F.broadcast(edge), F.lit(True)).select("device_id", (F.struct("created", "device_id") <= F.col("edge")).alias("monitored"))


def overview(devices: DataFrame, alerts: DataFrame) -> DataFrame:
    """Devices by health class and open root alerts by severity, as (what, n)."""
    health = F.when(~F.col("monitored"), "unmonitored").otherwise(F.col("status"))
    a = devices.groupBy(health.alias("what")).agg(F.count("*").alias("n"))
    b = alerts.where("state <> 'resolved' and root_cause is null").groupBy(F.concat(F.lit("alert:"), F.col("severity")).alias("what")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


#: Rates of a port that a device's traffic adds up.
RATES = ("in_bps", "out_bps", "in_pps", "out_pps", "in_err", "out_err", "in_drop", "out_drop")


def device_health(devices: DataFrame, interfaces: DataFrame, alerts: DataFrame, top: int = 3, listed: int = 6) -> DataFrame:
    """Interface counts, traffic (RATES) of physical and bundle ports that are up, the busiest and the down ports, and alerts of each device.

    Busiest are those of the highest whole percent of either direction; among equals those with errors or drops, then those with the most bits, then by name.
    """
    port = F.col("kind").isin("phys", "lag")
    down = F.col("admin_up") & ~F.col("oper_up") & port
    util = F.greatest("in_util", "out_util")
    busy = port & F.col("oper_up") & (F.col("speed_mbps") > 0) & (util > 0)
    faults = F.col("in_err") + F.col("out_err") + F.col("in_drop") + F.col("out_drop")
    order = F.struct(-F.floor(util), F.when(faults > 0, 0).otherwise(1), -(F.col("in_bps") + F.col("out_bps")), F.col("name"))
    first = lambda xs, n: F.array_join(F.transform(F.slice(F.array_sort(xs), 1, n), lambda x: x["name"]), ",")
    counted = port & F.col("oper_up")
    sides = interfaces.groupBy("device_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("admin_up") & F.col("oper_up")).alias("up"), F.count_if(down).alias("down"), F.count_if(~F.col("admin_up")).alias("admin_down"),
        F.count_if("important").alias("important"), F.count_if(down & F.col("important")).alias("important_down"),
        *[F.round(F.sum(F.when(counted, F.col(c)).otherwise(0.0)), 3).alias(c) for c in RATES], F.max(counted & (F.greatest("in_bps", "out_bps", "in_pps", "out_pps") > 0)).alias("have_rates"),
        first(F.collect_list(F.when(busy, F.struct(order.alias("o"), "name"))), top).alias("busiest"),
        first(F.collect_list(F.when(down, F.struct((~F.col("important")).alias("o"), "name"))), listed).alias("down_ports"), F.greatest(F.count_if(down) - listed, F.lit(0)).alias("down_more"),
    )
    open_ = alerts.where("state <> 'resolved'").groupBy("device_id").agg(F.count("*").alias("alerts"), F.max_by("severity", rank(F.col("severity"))).alias("worst"))
    return devices.select("device_id").join(sides, "device_id", "left").join(open_, "device_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def device_detail(devices: DataFrame, sites: DataFrame, interfaces: DataFrame, events: DataFrame) -> DataFrame:
    """A device with its site, its port names and the number of its events."""
    ports = interfaces.groupBy("device_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("ports"))
    n = events.groupBy("device_id").agg(F.count("*").alias("events"))
    rows = devices.join(sites.select("site_id", F.col("name").alias("site")), "site_id", "left").join(ports, "device_id", "left").join(n, "device_id", "left")
    return rows.select("device_id", "name", "site", "ports", F.coalesce("events", F.lit(0)).alias("events"))


def upsert_interfaces(new: DataFrame, old: DataFrame) -> DataFrame:
    """The ports of a device's new table with the live state of the old; ports of polled devices that are missing go, other devices' stay."""
    live = old.select("device_id", "if_index", F.col("status").alias("_s"))
    fresh = new.join(live, ["device_id", "if_index"], "left").select("device_id", "if_index", "name", F.coalesce("_s", F.lit("unknown")).alias("status"))
    others = old.join(new.select("device_id").distinct(), "device_id", "left_anti").select("device_id", "if_index", "name", "status")
    return fresh.unionByName(others)
