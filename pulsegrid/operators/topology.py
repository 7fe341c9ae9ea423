"""Topology: neighbour resolution, link synthesis, roles, parents and impact (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import short_host, short_port
from . import graphs

INFRA = ("core", "distribution", "access", "router", "firewall")
SWITCHES = ("core", "distribution", "access")


def resolve_neighbours(obs: DataFrame, devices: DataFrame) -> DataFrame:
    """Device of each observation by chassis MAC, then address, then name, then the name before a bracket; null if external."""
    by = lambda c, n: devices.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{n}")).agg(F.min("device_id").alias(f"_by_{n}"))
    named = devices.withColumn("_short", short_host(F.col("name"))).groupBy("_short").agg(F.min("device_id").alias("id"))
    head = F.trim(F.substring_index("remote_name", "(", 1))
    rows = obs.withColumns({"_mac": F.lower("remote_mac"), "_ip": F.col("remote_ip"), "_n1": short_host(F.col("remote_name")), "_n2": short_host(head)})
    rows = rows.join(by("mac", "mac"), "_mac", "left").join(by("ip", "ip"), "_ip", "left")
    rows = rows.join(named.select(F.col("_short").alias("_n1"), F.col("id").alias("_by_n1")), "_n1", "left").join(named.select(F.col("_short").alias("_n2"), F.col("id").alias("_by_n2")), "_n2", "left")
    return rows.withColumn("remote", F.coalesce("_by_mac", "_by_ip", "_by_n1", "_by_n2")).drop("_mac", "_ip", "_n1", "_n2", "_by_mac", "_by_ip", "_by_n1", "_by_n2")


def resolve_ports(refs: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Interface name of (device_id, ref): by index (ifindex:n or n), by short name, by the port's MAC (a column that may be missing), else the reference as given."""
    by_index = interfaces.select("device_id", F.col("if_index").cast("string").alias("ref"), F.col("name").alias("_a"))
    by_name = interfaces.groupBy("device_id", short_port(F.col("name")).alias("_short")).agg(F.min("name").alias("_b"))
    refs = refs.withColumns({"_ref": F.col("ref"), "ref": F.regexp_replace(F.trim("ref"), "^ifindex:", "")})
    if "mac" in interfaces.columns:
        by_mac = interfaces.where("mac is not null").groupBy("device_id", F.lower("mac").alias("_mac")).agg(F.min("name").alias("_c"))
        shaped = F.when(F.col("ref").rlike("^[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}$|^[0-9A-Fa-f]{4}([.][0-9A-Fa-f]{4}){2}$"), F.lower("ref"))
        refs = refs.withColumn("_mac", shaped).join(by_mac, ["device_id", "_mac"], "left").drop("_mac")
    else:
        refs = refs.withColumn("_c", F.lit(None).cast("string"))
    rows = refs.join(by_index, ["device_id", "ref"], "left").withColumn("_short", short_port(F.col("ref"))).join(by_name, ["device_id", "_short"], "left")
    return rows.withColumn("port", F.coalesce("_a", "_b", "_c", F.trim("_ref"))).withColumn("ref", F.col("_ref")).drop("_a", "_b", "_c", "_short", "_ref")


def link_id(*ends: Column) -> Column:
    """Twelve hex digits of a SHA-1 over both ends."""
    return F.substring(F.sha1(F.concat_ws("|", *ends).cast("binary")), 1, 12)


def synthesise_links(obs: DataFrame) -> DataFrame:
    """One link for each pair of ends of neighbour observations (device_id, local_if, remote_id, remote_if, source); self links go.

    Ends are ordered, so both sides group together. confidence: 0.8 seen from one side, 1.0 from both, 0.6 external (no
    remote_id), 0.05 more for several sources, 1 at most.
    """
    rows = obs.withColumns({"l": F.struct(F.coalesce(F.col("device_id"), F.lit(-1)).alias("d"), F.col("local_if").alias("i")), "r": F.struct(F.coalesce(F.col("remote_id"), F.lit(-1)).alias("d"), F.col("remote_if").alias("i"))})
    rows = rows.where("remote_id is null or device_id <> remote_id").withColumns({"a": F.when(F.col("remote_id").isNull(), F.col("l")).otherwise(F.least("l", "r")), "b": F.when(F.col("remote_id").isNull(), F.col("r")).otherwise(F.greatest("l", "r"))})
    grouped = rows.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n"), F.countDistinct("device_id").alias("sides"), F.max(F.col("remote_id").isNull()).alias("external"))
    base = F.when(F.col("external"), 0.6).when(F.col("sides") > 1, 1.0).otherwise(0.8)
    confidence = F.round(F.least(base + F.when(F.col("n") > 1, 0.05).otherwise(0.0), F.lit(1.0)), 2)
    ident = link_id(F.col("a.d").cast("string"), F.col("a.i"), F.col("b.d").cast("string"), F.col("b.i"))
    return grouped.select(ident.alias("id"), F.col("a.d").alias("a_device"), F.col("a.i").alias("a_if"), F.col("b.d").alias("b_device"), F.col("b.i").alias("b_if"), "sources", confidence.alias("confidence"), "external")


def carry_links(new: DataFrame, old: DataFrame, now: int, keep: int = 7 * 86400) -> DataFrame:
    """New links with the first-seen time of the old; old ones that aren't seen are stale, and go after `keep` seconds unless manual."""
    n = new.select("id", F.lit(True).alias("_new"))
    rows = old.join(n, "id", "full_outer")
    seen = F.col("_new").isNotNull()
    rows = rows.select("id", F.coalesce("first_seen", F.lit(now)).cast("long").alias("first_seen"), F.when(seen, F.lit(now)).otherwise(F.col("last_seen")).cast("long").alias("last_seen"), (~seen).alias("stale"), F.coalesce("manual", F.lit(False)).alias("manual"))
    return rows.where(~F.col("stale") | F.col("manual") | (F.col("last_seen") >= now - keep))


def one_peer_per_port(links: DataFrame) -> DataFrame:
    """A stale or weaker link goes where a port of it has a link of full confidence."""
    ends = links.where("not stale and confidence >= 1").select(F.explode(F.array(F.struct(F.col("a_device").alias("d"), F.col("a_if").alias("i")), F.struct(F.col("b_device").alias("d"), F.col("b_if").alias("i")))).alias("x")).select("x.*").distinct()
    weak = links.where("stale or confidence < 1")
    for d, i in (("a_device", "a_if"), ("b_device", "b_if")):
        weak = weak.join(ends.select(F.col("d").alias(d), F.col("i").alias(i)), [d, i], "left_anti")
    return links.where("not stale and confidence >= 1").unionByName(weak)


def link_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old.select("id"), "id", "left_anti").select("id", F.lit("link_new").alias("kind")).unionByName(old.join(new.select("id"), "id", "left_anti").select("id", F.lit("link_lost").alias("kind")))


def external_nodes(obs: DataFrame) -> DataFrame:
    """Nodes for neighbours outside the inventory, by short name or else by MAC."""
    node = F.coalesce(F.nullif(short_host(F.col("remote_name")), F.lit("")), F.lower("remote_mac"))
    return obs.where("remote is null").groupBy(F.concat(F.lit("ext:"), node).alias("node")).agg(F.count("*").alias("seen"))


def link_load(links: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Speed and utilisation of a link: the greater of both ends."""
    side = lambda s: interfaces.select(F.col("device_id").alias(f"{s}_device"), F.col("name").alias(f"{s}_if"), F.col("speed_mbps").alias(f"_{s}s"), F.col("util").alias(f"_{s}u"))
    rows = links.join(side("a"), ["a_device", "a_if"], "left").join(side("b"), ["b_device", "b_if"], "left")
    return rows.select("a_device", "b_device", F.greatest("_as", "_bs").alias("speed_mbps"), F.greatest("_au", "_bu").alias("util"))


#: What marks an important port in its alias, and prefixes of names that a digit follows.
ALIAS_MARKS = ("uplink", "trunk", "core", "wan", "dist", "isp", "backbone", "to-", "link to", "-> ")
NAME_PREFIXES = ("port-channel", "po", "ae", "bundle-ether", "lag", "te", "ten", "twe", "hu", "fo", "et-", "xe-", "sfp")


def important_ports(interfaces: DataFrame, links: DataFrame, devices: DataFrame) -> DataFrame:
    """Ports between two infrastructure devices, or whose alias or name says so."""
    infra = devices.where(F.col("role").isin(*INFRA)).select("device_id")
    between = links.join(infra.withColumnRenamed("device_id", "a_device"), "a_device", "left_semi").join(infra.withColumnRenamed("device_id", "b_device"), "b_device", "left_semi")
    ends = between.select(F.explode(F.array(F.struct(F.col("a_device").alias("device_id"), F.lower("a_if").alias("_n")), F.struct(F.col("b_device").alias("device_id"), F.lower("b_if").alias("_n")))).alias("x")).select("x.*", F.lit(True).alias("_linked")).distinct()
    marks = F.lower("alias").rlike("|".join(m.replace("-", r"\-") for m in ALIAS_MARKS)) | F.lower("name").rlike(f"^({'|'.join(NAME_PREFIXES)})[0-9]")
    rows = interfaces.withColumn("_n", F.lower("name")).join(ends, ["device_id", "_n"], "left")
    return rows.withColumn("important", F.coalesce("_linked", F.lit(False)) | F.coalesce(marks, F.lit(False))).drop("_n", "_linked")


def neighbours(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a_device").alias("device_id"), F.col("b_device").alias("peer")).unionAll(links.select(F.col("b_device").alias("device_id"), F.col("a_device").alias("peer")))
    return both.distinct()


def infer_roles(devices: DataFrame, links: DataFrame) -> DataFrame:
    """Roles of switches by site: the two best connected (within one of the top, preferably at the edge) are core, those between
    the core and another switch distribution, others access. Other devices and locked roles stay; external and stale links don't count."""
    peers = neighbours(links.where("not external and not stale"))
    role = devices.select(F.col("device_id").alias("peer"), F.col("role").alias("peer_role"))
    facts = peers.join(role, "peer", "left").groupBy("device_id").agg(F.count("*").alias("degree"), F.max(F.coalesce(F.col("peer_role").isin("router", "firewall"), F.lit(False))).alias("edge"))
    switch = devices.where(F.col("role").isin(*SWITCHES)).join(facts, "device_id", "left").select("device_id", "site_id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("edge", F.lit(False)).alias("edge"))
    site = Window.partitionBy("site_id")
    cand = switch.withColumn("top", F.max("degree").over(site)).where("top >= 2 and degree >= 2 and degree >= top - 1").withColumn("any_edge", F.max("edge").over(site)).where("edge or not any_edge")
    core = cand.withColumn("place", F.row_number().over(site.orderBy(F.desc("degree"), "name"))).where("place <= 2").select("device_id")
    core_peer, switch_peer = core.select(F.col("device_id").alias("peer"), F.lit(True).alias("is_core")), switch.select(F.col("device_id").alias("peer"), F.lit(True).alias("is_switch"))
    around = peers.join(core_peer, "peer", "left").join(switch_peer, "peer", "left").groupBy("device_id").agg(F.max(F.coalesce("is_core", F.lit(False))).alias("touches"), F.sum((F.col("is_core").isNull() & F.coalesce("is_switch", F.lit(False))).cast("int")).alias("below"))
    rows = devices.join(core.withColumn("_core", F.lit(True)), "device_id", "left").join(around, "device_id", "left")
    made = F.when(~F.col("role").isin(*SWITCHES) | F.col("locked"), F.col("role")).when(F.col("_core"), "core").when(F.col("touches") & (F.col("below") > 0), "distribution").otherwise("access")
    return rows.select("device_id", "site_id", made.alias("role"))


#: Which role a site's root has first.
ROOT_RANK = {"core": 4, "router": 3, "firewall": 3, "distribution": 2, "access": 1}


def parents(devices: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Upstream device of each device, and its hops from the nearest root.

    A site's root is its core, else a router or firewall, else a distribution, an access switch, another device; of several the one with the most
    links (parallel ones count), then the smallest id. A site of which that device has no link has no root. `roots` (device_id) are roots
    besides. Links that are external or stale (columns that may be missing) count nowhere. Of equally near parents the smallest id
    counts; a device that no path reaches has neither parent nor hop.
    """
    for c in ("external", "stale"):
        links = links.where(~F.coalesce(F.col(c), F.lit(False))) if c in links.columns else links
    order = F.create_map(*[F.lit(x) for kv in ROOT_RANK.items() for x in kv])[F.col("role")]
    ends = links.select(F.col("a_device").alias("device_id")).unionAll(links.select(F.col("b_device").alias("device_id"))).groupBy("device_id").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("site_id").orderBy(F.desc("_o"), F.desc("_n"), "device_id")
    ranked = devices.join(ends, "device_id", "left").withColumns({"_o": F.coalesce(order, F.lit(0)), "_n": F.coalesce("_n", F.lit(0))}).withColumn("_p", F.row_number().over(w))
    top = ranked.where("_p = 1 and _n > 0").select(F.col("device_id").cast("long").alias("node"))
    top = top if roots is None else top.unionAll(roots.select(F.col("device_id").cast("long")))
    edges = links.select(F.col("a_device").cast("long").alias("a"), F.col("b_device").cast("long").alias("b"), F.lit(1).cast("long").alias("w")).where("a <> b").distinct()
    dist = graphs.distances(edges, top)
    up = graphs.nearest_parents(edges, dist)
    rows = devices.select("device_id").join(dist.select(F.col("node").alias("device_id"), F.col("dist").cast("int").alias("hop")), "device_id", "left")
    return rows.join(up.select(F.col("node").alias("device_id"), "parent"), "device_id", "left").select("device_id", "parent", "hop")


def impact(tree: DataFrame) -> DataFrame:
    """Number of devices below each one in the parent tree (device_id, parent)."""
    found = graphs.below(tree.select(F.col("device_id").alias("node"), "parent"))
    return tree.select("device_id").join(found.select(F.col("node").alias("device_id"), F.col("n").alias("below")), "device_id", "left").select("device_id", F.coalesce("below", F.lit(0)).alias("below"))


def view(links: DataFrame, devices: DataFrame, alerts: DataFrame, site: int | None = None, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of a site (or of all): links that are sure enough or manual and have an end in it; its devices with their open
    alerts, and a node of status unknown for the external end of each link shown, one for each name."""
    own = devices if site is None else devices.where(F.col("site_id") == site)
    n = alerts.where("state <> 'resolved'").groupBy("device_id").agg(F.count("*").alias("alerts"))
    rows = links.where((F.col("confidence") >= least) | F.col("manual"))
    for s in ("a", "b"):
        rows = rows.join(own.select(F.col("device_id").alias(f"{s}_device"), F.lit(True).alias(f"_{s}")), f"{s}_device", "left")
        rows = rows.join(n.select(F.col("device_id").alias(f"{s}_device"), F.col("alerts").alias(f"{s}_alerts")), f"{s}_device", "left")
    rows = rows.where("_a or _b").drop("_a", "_b").withColumns({f"{s}_alerts": F.coalesce(f"{s}_alerts", F.lit(0)) for s in ("a", "b")})
    inside = own.join(n, "device_id", "left").select(F.col("device_id").cast("string").alias("node"), "name", "role", "status", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.lit(False).alias("external"))
    outside = rows.where("external").groupBy(F.concat(F.lit("ext:"), F.lower("external_name")).alias("node")).agg(F.min("external_name").alias("name"))
    return rows, inside.unionByName(outside.select("node", "name", F.lit("other").alias("role"), F.lit("unknown").alias("status"), F.lit(0).alias("alerts"), F.lit(True).alias("external")))


def hold_over(snapshots: DataFrame, now: int, age: int = 7200) -> DataFrame:
    """Each device's latest snapshot that isn't empty (device_id, at, n), unless it is older than `age`."""
    return snapshots.where("n > 0").groupBy("device_id").agg(F.max("at").alias("at"), F.max_by("n", "at").alias("n")).where(F.lit(now) - F.col("at") <= age)
