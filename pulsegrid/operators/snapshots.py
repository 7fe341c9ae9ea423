"""Protocol snapshots, controllers, probes and configurations (N, Q, C)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- routing and switching


def previous_walks(df: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """device_id, snapshot, previous: each walk of a device with the one before. walks: the ledger of all of them, those that found nothing too; else those with rows."""
    snaps = (df if walks is None else walks).select("device_id", "snapshot").distinct()
    return snaps.withColumn("previous", F.lag("snapshot").over(Window.partitionBy("device_id").orderBy("snapshot"))).where("previous is not null")


def walked_pairs(df: DataFrame, walks: DataFrame | None, key: str, values: list[str]) -> DataFrame:
    """device_id, snapshot, key, values and was_<value>: what a walk and the one before it have of each key; nulls where one has none."""
    before = previous_walks(df, walks)
    new = df.join(before, ["device_id", "snapshot"]).select("device_id", "snapshot", key, *values)
    old = df.withColumnRenamed("snapshot", "previous").join(before, ["device_id", "previous"]).select("device_id", "snapshot", key, *[F.col(v).alias(f"was_{v}") for v in values])
    return new.join(old, ["device_id", "snapshot", key], "full_outer")


def peer_changes(df: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Changes of BGP peers between a device's walk and the one before: lost, regained, vanished, and prefixes below a quarter."""
    both = walked_pairs(df, walks, "peer", ["up", "prefixes"])
    kind = F.when(F.col("up").isNull() & F.col("was_up"), "vanished").when(F.col("was_up") & ~F.col("up"), "lost").when(~F.col("was_up") & F.col("up"), "regained").when(F.col("was_up") & F.col("up") & (F.col("prefixes") * 4 < F.col("was_prefixes")), "prefixes_dropped")
    return both.withColumn("kind", kind).where("kind is not null").select("device_id", "snapshot", "peer", "kind")


def adjacency_changes(df: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """OSPF neighbours that left full or vanished, and a device's recovery: one is full again, none was lost in the same walk, and all it has are full."""
    both = walked_pairs(df, walks, "peer", ["up"])
    kind = F.when(F.col("was_up") & F.col("up").isNull(), "vanished").when(F.col("was_up") & ~F.col("up"), "lost")
    rows = both.withColumn("kind", kind)
    lost = rows.where("kind is not null").select("device_id", "snapshot", F.col("peer").cast("long").alias("peer"), "kind")
    whole = rows.groupBy("device_id", "snapshot").agg(F.count("kind").alias("lost"), F.count_if(~F.col("was_up") & F.col("up")).alias("back"), F.bool_and("up").alias("full"))
    back = whole.where("lost = 0 and back > 0 and full").select("device_id", "snapshot", F.lit(None).cast("long").alias("peer"), F.lit("recovered").alias("kind"))
    return lost.unionByName(back)


def spanning_tree_changes(df: DataFrame) -> DataFrame:
    """root_changed where a device's root differs from its last one, else topology_change with the growth of the counter."""
    w = Window.partitionBy("device_id").orderBy("snapshot")
    rows = df.withColumns({"_root": F.lag("root").over(w), "_n": F.lag("changes").over(w)}).where("_root is not null")
    kind = F.when(F.col("root") != F.col("_root"), "root_changed").when(F.col("changes") > F.col("_n"), "topology_change")
    return rows.withColumn("kind", kind).where("kind is not null").select("device_id", "snapshot", "kind", F.when(F.col("kind") == "topology_change", F.col("changes") - F.col("_n")).alias("delta"))


def bundle_changes(df: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Bundles (up, members) that lost members since the walk before, or have all of them again; one that wasn't in that walk says nothing."""
    rows = walked_pairs(df, walks, "bundle", ["up", "members"])
    kind = F.when(F.col("up") < F.col("was_up"), "member_down").when((F.col("up") > F.col("was_up")) & (F.col("up") == F.col("members")), "complete")
    return rows.withColumn("kind", kind).where("kind is not null").select("device_id", "bundle", "snapshot", "kind")


def path_changes(df: DataFrame) -> DataFrame:
    """WAN paths that went down (down at first sight counts) or came back, and those up but with loss of 5 % or latency of 250 ms."""
    was = F.coalesce(F.lag("up").over(Window.partitionBy("device_id", "path").orderBy("at")), F.lit(True))
    rows = df.withColumn("_was", was)
    bad = F.col("up") & ((F.col("loss") >= 5) | (F.col("latency") >= 250))
    kind = F.when(F.col("_was") & ~F.col("up"), "down").when(~F.col("_was") & F.col("up"), "up").when(bad, "degraded")
    return rows.withColumn("kind", kind).where("kind is not null").select("device_id", "path", "at", "kind")


def merge_inventory(found: DataFrame, known: DataFrame) -> DataFrame:
    """Members of a controller: found ones with their state, known ones that are missing as down."""
    rows = found.select("id", F.col("status").alias("_s")).join(known.select("id", F.lit(True).alias("_k")), "id", "full_outer")
    return rows.select("id", F.coalesce("_s", F.lit("down")).alias("status"), F.col("_k").isNull().alias("is_new"), F.col("_s").isNull().alias("missing"))


def member_samples(found: DataFrame, known: DataFrame, controller: str, now: int) -> DataFrame:
    """One poll sample for each monitored member of a controller (id, up / id, monitored): a found one by its state, a missing one as down; new ones count as monitored."""
    rows = found.select("id", "up").join(known.select("id", "monitored"), "id", "full_outer").where(F.coalesce("monitored", F.lit(True)))
    up = F.coalesce("up", F.lit(False))
    error = F.when(F.col("up").isNull(), f"no longer listed by controller {controller}").when(~up, f"controller {controller} reports the access point down")
    return rows.select(F.col("id").alias("device_id"), F.lit(now).alias("ts"), up.alias("reachable"), up.alias("snmp_ok"), error.alias("error"))


def clients(stations: DataFrame, points: DataFrame) -> DataFrame:
    """Clients of each access point and SSID, with the point's total: the sum of its radios' counts, or of its SSIDs where that is 0."""
    each = stations.join(points.select("mac", "ap", "radio_clients"), "mac").groupBy("ap", "ssid", "radio_clients").agg(F.count("*").alias("clients"))
    total = F.coalesce(F.nullif(F.col("radio_clients"), F.lit(0)), F.sum("clients").over(Window.partitionBy("ap")))
    return each.select("ap", "ssid", "clients", total.cast("long").alias("ap_clients"))


def bitmap_members(df: DataFrame, interfaces: DataFrame, most: int = 64) -> DataFrame:
    """Port names of VLANs from bitmaps in hex (the first port is the top bit): the first `most` in port order, and their number."""
    bit = F.explode(F.sequence(F.lit(1), F.length("ports") * 4))
    rows = df.select("device_id", "vlan", "ports", bit.alias("if_index"))
    digit = F.conv(F.substring(F.col("ports"), F.floor((F.col("if_index") - 1) / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    on = rows.where(F.getbit(digit, F.lit(3) - (F.col("if_index") - 1) % 4) == 1)
    named = on.join(interfaces.select("device_id", F.col("if_index").cast("int").alias("if_index"), "name"), ["device_id", "if_index"])
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("if_index", "name"))), 1, most), lambda x: x["name"])
    return named.groupBy("device_id", "vlan").agg(F.array_join(listed, ",").alias("members"), F.count("*").alias("n"))


def spanning_tree_summary(ports: DataFrame, most: int = 32) -> DataFrame:
    """Root flag (no root port), forwarding and blocking counts, and the first blocked ports."""
    blocked = F.array_sort(F.collect_list(F.when(F.col("state") == "blocking", F.col("port"))))
    return ports.groupBy("device_id").agg((F.count_if(F.col("role") == "root") == 0).alias("is_root"), F.count_if(F.col("state") == "forwarding").alias("forwarding"), F.count_if(F.col("state") == "blocking").alias("blocking"), F.array_join(F.transform(F.slice(blocked, 1, most), lambda x: x.cast("string")), ",").alias("blocked"))


def bundles(attached: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Members of each bundle (device_id, bundle, if_index), a bundle not being its own, and how many are up."""
    rows = attached.where("bundle <> if_index").join(interfaces.select("device_id", "if_index", "oper_up"), ["device_id", "if_index"], "left")
    return rows.groupBy("device_id", "bundle").agg(F.count("*").alias("members"), F.count_if(F.coalesce("oper_up", F.lit(False))).alias("up"))


#: BGP states by code.
PEER_STATES = {1: "idle", 2: "connect", 3: "active", 4: "opensent", 5: "openconfirm", 6: "established"}


def peer_table(walk: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Peers from walk columns (device_id, idx, column, value) with state names and their accepted prefixes summed."""
    wide = walk.groupBy("device_id", "idx").pivot("column", ["state", "remote_as"]).agg(F.first("value"))
    name = F.create_map(*[F.lit(x) for kv in PEER_STATES.items() for x in kv])[F.col("state").cast("int")]
    sums = prefixes.groupBy("device_id", "idx").agg(F.sum("accepted").alias("prefixes"))
    return wide.join(sums, ["device_id", "idx"], "left").select("device_id", "idx", name.alias("state"), F.col("remote_as").cast("long").alias("remote_as"), F.coalesce("prefixes", F.lit(0)).alias("prefixes"))


# ---- probes


def probe_summary(df: DataFrame, runs: int = 120) -> DataFrame:
    """Over the last runs of each probe: ok percent, mean time of good runs, the last result and the failures since the last good one."""
    w = Window.partitionBy("probe_id").orderBy(F.desc("ts"), F.desc("run_id"))
    rows = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= runs)
    first_ok = F.min(F.when(F.col("ok"), F.col("_n")))
    return rows.groupBy("probe_id").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("ok").cast("int")) * 100, 6).alias("ok_pct"), F.round(F.avg(F.when(F.col("ok"), F.col("ms"))), 6).alias("mean_ms"), F.max_by("ok", -F.col("_n")).alias("last_ok"), (F.coalesce(first_ok, F.count("*") + 1) - 1).alias("fail_streak"))


def probe_events(df: DataFrame, fails: int = 2) -> DataFrame:
    """probe_failed at the `fails`-th failure in a row, probe_ok at the first good run after that."""
    from .state import streaks

    rows = streaks(df, "probe_id", "ok", ["ts", "run_id"])
    was = F.lag("fails").over(Window.partitionBy("probe_id").orderBy("ts", "run_id"))
    kind = F.when(F.col("fails") == fails, "probe_failed").when(F.col("ok") & (F.col("_was") >= fails), "probe_ok")
    return rows.withColumn("_was", was).withColumn("kind", kind).where("kind is not null").select("probe_id", "run_id", "kind")


def status_matches(code: Column, wanted: Column) -> Column:
    """Whether an HTTP status is in a list of codes and ranges such as 200-299,301."""
    low, high = (lambda p: F.get(F.split(p, "-"), F.lit(0)).try_cast("int")), (lambda p: F.get(F.split(p, "-"), F.lit(1)).try_cast("int"))
    one = lambda p: F.coalesce(F.when(F.instr(p, "-") > 0, code.between(F.coalesce(low(p), F.lit(0)), F.coalesce(high(p), F.lit(0)))).otherwise(p.try_cast("int") == code), F.lit(False))
    return F.exists(F.transform(F.split(wanted, ","), lambda x: F.trim(x)), one)


def certificate_events(df: DataFrame, warn: int = 14) -> DataFrame:
    """Days left, with their fraction; `expiring` when they first fall below the limit, `renewed` when they are no longer, `expired` below 0."""
    left = F.round((F.col("expires").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400, 6)
    w = Window.partitionBy("probe_id").orderBy("ts", "run_id")
    rows = df.withColumn("days", left).withColumn("_warn", F.col("days") < warn)
    was = F.coalesce(F.lag("_warn").over(w), F.lit(False))
    kind = F.when(F.col("days") < 0, "expired").when(F.col("_warn") & ~F.col("_was"), "expiring").when(~F.col("_warn") & F.col("_was"), "renewed")
    return rows.withColumn("_was", was).withColumn("kind", kind).where("kind is not null").select("probe_id", "run_id", "days", "kind")


def route_changes(df: DataFrame) -> DataFrame:
    """Runs whose path of answering hops differs from the run before."""
    rows = df.withColumn("path", F.array_join(F.filter("hops", lambda h: h.isNotNull() & (h != "")), ">"))
    was = F.lag("path").over(Window.partitionBy("probe_id").orderBy("ts", "run_id"))
    return rows.withColumn("previous", was).where("previous <> path").select("probe_id", "run_id", "previous", "path")


# ---- configurations

#: How lines begin that change by themselves, by platform.
VOLATILE = {
    "cisco-ios": ("! Last configuration change", "! NVRAM config last updated", "! No configuration change since", "! Time:", "ntp clock-period", "Building configuration", "Current configuration"),
    "cisco-nxos": ("!Command:", "!Running configuration last done at", "!Time:", "!No entry for"),
    "cisco-asa": (": Written by", ": Saved", ": Serial Number", ": Hardware", ": Call-home", "ASA Version", "Cryptochecksum"),
    "fortinet-fortigate": ("#conf_file_ver=", "#buildno=", "#global_vdom=", "#config-version="),
    "paloalto": ("Entering configuration mode", "[edit]"),
    "juniper": ("## Last commit:", "## Last changed:"),
    "aruba-aos-s": ("; Ver ",),
    "aruba-aos-cx": ("Current configuration:", "!Version", "!export-password"),
    "mikrotik": ("# software id =", "# model =", "# serial number ="),
    "huawei": ("!Software Version", "!Last configuration was"),
    "ubiquiti": (),
    "net-snmp": (),
    "generic": (),
}


def volatile(line: Column, platform: str) -> Column:
    """Whether a line of a platform's configuration changes by itself: by its beginning, or by what stands further on."""
    begins = lambda head: F.startswith(line, F.lit(head))
    holds = lambda *parts: reduce(lambda a, b: a | b, [F.contains(line, F.lit(p)) for p in parts])
    dated = F.substring(line, 3, 10).try_cast("date").isNotNull()
    more = {
        "cisco-asa": F.trim(line) == "",
        "juniper": begins("# ") & dated,
        "aruba-aos-s": begins("; ") & holds(" Configuration Editor; Created on release"),
        "mikrotik": begins("# ") & holds(" by RouterOS"),
        "ubiquiti": begins("set system ") & holds("login", "time-zone"),
        "net-snmp": F.startswith(F.ltrim(line), F.lit("valid_lft")),
        "generic": begins("!") & holds("change", "updated", "Time"),
    }
    return reduce(lambda a, b: a | b, [*map(begins, VOLATILE[platform]), *([more[platform]] if platform in more else [])])


def normalised(config: Column, platform: Column | str = "generic") -> Column:
    """A configuration without the volatile lines of its platform (another name counts as generic) and trailing blanks, ended by one line feed."""
    lines = F.split(config, "\n", -1)
    keep = lambda name: F.filter(lines, lambda x: ~volatile(x, name))
    kept = keep(platform) if isinstance(platform, str) else keep("generic")
    if not isinstance(platform, str):
        for name in VOLATILE:
            kept = F.when(platform == name, keep(name)).otherwise(kept)
    body = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, "[ \t]+$", "")), "\n")
    return F.concat(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))


def versions(df: DataFrame, platform: Column | str = "generic") -> DataFrame:
    """Versions that differ from the one before by the hash of their normalised text, and how often each was seen again."""
    w = Window.partitionBy("device_id").orderBy("seq")
    rows = df.withColumn("hash", F.sha2(normalised(F.col("config"), platform), 256))
    rows = rows.withColumn("_new", F.coalesce((F.col("hash") != F.lag("hash").over(w)).cast("int"), F.lit(1))).withColumn("version", F.sum("_new").over(w))
    return rows.groupBy("device_id", "version").agg(F.min("seq").alias("seq"), F.min_by("hash", "seq").alias("hash"), (F.count("*") - 1).alias("unchanged"), F.min_by("config", "seq").alias("config"))


def common_lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of x and each head of y (0 to all of its lines), a bit for each line of y."""
    places: dict[str, int] = {}
    for j, line in enumerate(y):
        places[line] = places.get(line, 0) | 1 << j
    every = (1 << len(y)) - 1
    row = every
    for line in x:
        hit = row & places.get(line, 0)
        if hit:
            row = (row + hit | row - hit) & every
    steps = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


def matched(x: list[str], y: list[str], at: int = 0, to: int = 0) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of x and y (in texts where they begin at `at` and `to`).

    x is halved and y cut where both halves together have most in common, and so on: memory grows with the lines, whatever the texts.
    """
    if not x or not y:
        return []
    if len(x) == 1:
        return [(at, to + y.index(x[0]))] if x[0] in y else []
    mid = len(x) // 2
    head, tail = common_lengths(x[:mid], y), common_lengths(x[mid:][::-1], y[::-1])[::-1]
    cut = int((head + tail).argmax())
    return matched(x[:mid], y[:cut], at, to) + matched(x[mid:], y[cut:], at + mid, to + cut)


def line_ops(old: str, new: str) -> list[tuple[str, str]]:
    """Lines as equal, removed or added, with the least number of removed and added ones at every size; removed ones come before added ones."""
    a, b = old.split("\n"), new.split("\n")
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    same = matched(a[head : len(a) - tail], b[head : len(b) - tail], head, head)
    out: list[tuple[str, str]] = [("=", s) for s in a[:head]]
    i = j = head
    for k, m in [*same, (len(a) - tail, len(b) - tail)]:
        out += [("-", s) for s in a[i:k]] + [("+", s) for s in b[j:m]]
        if k < len(a) - tail:
            out.append(("=", a[k]))
        i, j = k + 1, m + 1
    return out + [("=", s) for s in a[len(a) - tail :]]


def hunks(ops: list[tuple[str, str]], context: int = 3) -> list[str]:
    """Changed lines with `context` equal lines around them; what touches is one hunk."""
    near = sorted({k for i, (op, _) in enumerate(ops) if op != "=" for k in range(max(0, i - context), min(len(ops), i + context + 1))})
    out: list[list[str]] = []
    for n, i in enumerate(near):
        if not n or near[n - 1] != i - 1:
            out.append([])
        out[-1].append((" " if ops[i][0] == "=" else ops[i][0]) + ops[i][1])
    return ["\n".join(h) for h in out]


def diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """added, removed and hunks of text pairs (old, new), each pair diffed where it is; other columns stay."""
    from pyspark.sql.types import StructType

    kept = [c for c in pairs.columns if c not in ("old", "new")]
    schema = StructType([pairs.schema[c] for c in kept]).add("added", "integer").add("removed", "integer").add("n_hunks", "integer").add("diff", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for old, new in zip(rows["old"], rows["new"]):
                ops = line_ops(old or "", new or "")
                found = hunks(ops, context)
                made.append((sum(o == "+" for o, _ in ops), sum(o == "-" for o, _ in ops), len(found), "\n--\n".join(found)))
            yield pd.concat([rows[kept].reset_index(drop=True), pd.DataFrame(made, columns=["added", "removed", "n_hunks", "diff"]).astype({"added": "int32", "removed": "int32", "n_hunks": "int32"})], axis=1)

    return pairs.mapInPandas(run, schema)


def consecutive(versions_: DataFrame) -> DataFrame:
    """Each version's text beside the one before."""
    w = Window.partitionBy("device_id").orderBy("seq")
    return versions_.select("device_id", "seq", F.lag("config").over(w).alias("old"), F.col("config").alias("new")).where("old is not null")


def chosen(versions_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Any two versions' texts side by side: wanted names device_id, old_seq, new_seq."""
    text = lambda seq, name: versions_.select("device_id", F.col("seq").alias(seq), F.col("config").alias(name))
    return wanted.join(text("old_seq", "old"), ["device_id", "old_seq"]).join(text("new_seq", "new"), ["device_id", "new_seq"])


def keep_newest(df: DataFrame, key: str, order: str, most: int = 50) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def backup_overview(devices: DataFrame, runs: DataFrame) -> DataFrame:
    """Last run, last error and number of runs of each device; null where there is none."""
    last = runs.groupBy("device_id").agg(F.count("*").alias("runs"), F.max("at").alias("last_run"), F.max_by("error", "at").alias("error"))
    return devices.select("device_id").join(last, "device_id", "left").select("device_id", F.coalesce("runs", F.lit(0)).alias("runs"), "last_run", "error")


def backup_events(runs: DataFrame) -> DataFrame:
    """failing at the first error after a good run (or at first), working at the first good run after an error."""
    was = F.lag(F.col("error").isNotNull()).over(Window.partitionBy("device_id").orderBy("at"))
    rows = runs.withColumn("_bad", F.col("error").isNotNull()).withColumn("_was", F.coalesce(was, F.lit(False))).where("_bad <> _was")
    return rows.select("device_id", "at", F.when(F.col("_bad"), "failing").otherwise("working").alias("kind"))
