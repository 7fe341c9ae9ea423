"""Endpoints: placement of MAC addresses on ports, moves, ARP, vendors and search (E)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch, is_multicast


def uplink_ports(fdb: DataFrame, link_ends: DataFrame, neighbours: DataFrame, chassis: DataFrame) -> DataFrame:
    """Ports (device_id, if_index) with a neighbour or a link, or that learn another device's chassis MAC."""
    foreign = fdb.join(chassis.select("mac", F.col("device_id").alias("owner")), "mac").where("owner <> device_id").select("device_id", "if_index")
    return link_ends.select("device_id", "if_index").unionAll(neighbours.select("device_id", "if_index")).unionAll(foreign).distinct()


def port_load(fdb: DataFrame) -> DataFrame:
    """Distinct MACs of each port, before any filter."""
    return fdb.groupBy("device_id", "if_index").agg(F.countDistinct("mac").alias("load"))


def place(fdb: DataFrame, uplinks: DataFrame) -> DataFrame:
    """The port of each MAC: not an uplink, not multicast; the quietest port of each switch, then the quietest switch, the newest sighting on a tie."""
    load = port_load(fdb)
    rows = fdb.where(~F.substring("mac", 2, 1).isin(*"13579bdf")).join(uplinks, ["device_id", "if_index"], "left_anti")
    seen = rows.groupBy("mac", "device_id", "if_index").agg(F.max("ts").alias("ts")).join(load, ["device_id", "if_index"])
    best = Window.partitionBy("mac", "device_id").orderBy("load", F.desc("ts"), "if_index")
    one = seen.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    final = Window.partitionBy("mac").orderBy("load", F.desc("ts"), "device_id", "if_index")
    return one.withColumn("_n", F.row_number().over(final)).where("_n = 1").select("mac", "device_id", "if_index", "ts", "load")


def moves(now: DataFrame, before: DataFrame, still: DataFrame, within: int = 86400) -> DataFrame:
    """MACs on another port than before, where the old one no longer sees them and the MAC had been seen less than `within` seconds ago."""
    old = before.select("mac", F.col("device_id").alias("from_device"), F.col("if_index").alias("from_if"), epoch(F.col("ts")).alias("_seen"))
    rows = now.join(old, "mac").where((F.col("device_id") != F.col("from_device")) | (F.col("if_index") != F.col("from_if")))
    gone = still.select("mac", F.col("device_id").alias("from_device"), F.col("if_index").alias("from_if")).distinct()
    return rows.where(epoch(F.col("ts")) - F.col("_seen") < within).drop("_seen").join(gone, ["mac", "from_device", "from_if"], "left_anti")


def arp_merge(arp: DataFrame, most: int = 4) -> DataFrame:
    """The newest distinct addresses of each MAC; zero, link-local and multicast ones go."""
    ok = arp.where(~is_multicast(F.col("mac")) & ~F.col("ip").rlike(r"^(169\.254\.|0\.0\.0\.0$|255\.|22[4-9]\.|fe80:)"))
    last = ok.groupBy("mac", "ip").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("mac").orderBy(F.desc("ts"), "ip")
    rows = last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    ips = F.transform(F.array_sort(F.collect_list(F.struct("_n", "ip"))), lambda x: x["ip"])
    return rows.groupBy("mac").agg(F.array_join(ips, ",").alias("ips"), F.max("ts").alias("seen"))


def vendor_of(macs: DataFrame, registry: DataFrame) -> DataFrame:
    """Vendor by the longest registered prefix of 9, 7 or 6 hex digits, else `locally administered` by its bit, else empty."""
    rows = macs
    for n in (9, 7, 6):
        part = registry.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("vendor").alias(f"_v{n}"))
        rows = rows.withColumn(f"_p{n}", F.substring("mac", 1, n)).join(part, f"_p{n}", "left")
    local = F.when(F.substring("mac", 2, 1).isin(*"2367abef"), "locally administered")
    return rows.select(*macs.columns, F.coalesce("_v9", "_v7", "_v6", local, F.lit("")).alias("vendor"))


def search(rows: DataFrame, text: str = "", device: int | None = None, port: int | None = None, limit: int = 200) -> DataFrame:
    """Endpoints (mac, ips, vendor, device_id, arp_device, if_index, if_name, seen), newest first: by whole MAC, a part of at least
    four hex digits, an address prefix, or text in the vendor or port name; on one device (placed there or in its ARP
    table), and on one port of it. Text with dots between one to three digits ("10.2.1.") is an address, not part of a MAC."""
    text = text.strip().lower()
    plain = "".join(c for c in text if c not in ":.-")
    if device is not None:
        rows = rows.where((F.col("device_id") == device) | (F.col("arp_device") == device))
    if port:
        rows = rows.where((F.col("device_id") == device) & (F.col("if_index") == port))
    if text:
        has = lambda c: F.coalesce(F.lower(c).contains(text), F.lit(False))
        test = F.coalesce(F.exists(F.split("ips", ","), lambda x: x.startswith(text)), F.lit(False)) | has("vendor") | has("if_name")
        address = re.fullmatch(r"\d{1,3}(\.\d{1,3}){0,3}\.?", text) and "." in text
        if len(plain) >= 4 and not address and all(c in "0123456789abcdef" for c in plain):
            test = test | F.replace("mac", F.lit(":"), F.lit("")).contains(plain)
        rows = rows.where(test)
    return rows.orderBy(F.desc("seen"), "mac").limit(limit)


def per_port(placed: DataFrame) -> DataFrame:
    return placed.groupBy("device_id", "if_index").agg(F.count("*").alias("endpoints"))


def statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("endpoints"), F.count_if(F.col("device_id").isNotNull()).alias("placed"), F.count_if(F.col("ips").isNotNull()).alias("with_ip"))


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The table's size limit: the `most` endpoints seen last."""
    return rows.orderBy(F.desc("ts"), "mac").limit(most)


def forget(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """Endpoints on devices that are gone lose their place."""
    rows = placed.join(gone.select("device_id", F.lit(True).alias("_gone")), "device_id", "left")
    keep = lambda c: F.when(F.col("_gone").isNull(), F.col(c)).alias(c)
    return rows.select("mac", keep("device_id"), keep("if_index"))
