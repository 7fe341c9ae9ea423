"""Alert lifecycle: rules, upsert and re-opening, folding, archive, lists and notification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import civil_time, epoch, rank
from ..functions.folds import scan

#: Rules as id, object, metric, enter, exit, cycles, severity, important ports only.
RULES = [
    ("device_down", "device", None, None, None, 3, "major", False), ("snmp_unreachable", "device", None, None, None, 3, "minor", False),
    ("icmp_loss", "device", "icmp_loss_pct", 20.0, 5.0, 2, "minor", False), ("icmp_latency", "device", "icmp_rtt_ms", 150.0, 100.0, 3, "minor", False),
    ("device_cpu_high", "device", "cpu_pct", 85.0, 70.0, 5, "major", False), ("device_mem_high", "device", "mem_pct", 90.0, 80.0, 5, "minor", False),
    ("device_temp_high", "device", "temp_c", 70.0, 60.0, 2, "major", False), ("interface_down", "interface", None, None, None, 1, "major", True),
    ("interface_util_high", "interface", "util_pct", 85.0, 70.0, 5, "minor", True), ("interface_errors", "interface", "err_rate", 1.0, 0.1, 3, "minor", True),
    ("flapping", "any", None, None, None, 5, "major", False), ("site_down", "site", None, 80.0, None, 0, "critical", False),
    ("device_rebooted", "event", None, None, None, 30, "major", False), ("config_changed", "event", None, None, None, 30, "minor", False),
    ("bgp_neighbor_down", "event", None, None, None, 0, "major", False), ("ospf_adjacency_down", "event", None, None, None, 0, "major", False),
    ("ha_state_change", "event", None, None, None, 60, "major", False), ("environment_fault", "event", None, None, None, 120, "major", False),
    ("critical_log", "event", None, None, None, 60, "major", False), ("auth_failure", "event", None, 20.0, None, 5, "minor", False),
    ("log_flood", "event", None, None, None, 30, "minor", False), ("vpn_tunnel_change", "event", None, None, None, 30, "minor", False),
    ("device_over_cap", "event", None, None, None, 1440, "minor", False), ("neighbor_changed", "event", None, None, None, 60, "minor", False),
    ("probe_failed", "event", None, None, None, 0, "major", False), ("tls_expiring", "event", None, None, None, 0, "minor", False),
    ("path_changed", "event", None, None, None, 0, "info", False), ("stp_root_changed", "event", None, None, None, 60, "major", False),
    ("stp_topology_change", "event", None, None, None, 30, "minor", False), ("bgp_prefixes_dropped", "event", None, None, None, 60, "minor", False),
    ("lag_member_down", "event", None, None, None, 0, "minor", False), ("sdwan_link_down", "event", None, None, None, 0, "major", False),
    ("sdwan_degraded", "event", None, None, None, 30, "minor", False), ("integration_failed", "event", None, None, None, 0, "minor", False),
    ("config_backup_failed", "event", None, None, None, 0, "minor", False), ("config_backup_changed", "event", None, None, None, 0, "info", False),
    ("endpoint_moved", "event", None, None, None, 0, "info", False),
]
RULE_SCHEMA = "id string, object string, metric string, enter double, leave double, cycles int, severity string, important boolean"
#: Events that end what another kind began.
CLEARS = {"bgp_neighbor_up": "bgp", "ospf_adjacency_up": "ospf", "probe_ok": "probe_failed", "link_up": "link_down"}


def rule_table(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """The rules, an override replacing the default of its id."""
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return rules if overrides is None else rules.join(overrides.select("id"), "id", "left_anti").unionByName(overrides)


def alerts_from_events(events: DataFrame, rules: DataFrame, cut: int = 120) -> DataFrame:
    """Alerts of events (kind, device_id, object, message, dedup_key) whose kind is an event rule above info; titles are cut."""
    own = F.broadcast(rules.where("object = 'event' and severity <> 'info'").select(F.col("id").alias("kind"), "severity"))
    title = F.when(F.length("message") > cut, F.concat(F.substring("message", 1, cut), F.lit("…"))).otherwise(F.col("message"))
    return events.join(own, "kind").withColumn("title", title).withColumn("dedup_key", F.coalesce("dedup_key", F.concat_ws(":", "kind", F.col("device_id").cast("string"))))


def clearing_keys(events: DataFrame) -> DataFrame:
    """Dedup keys that clearing events resolve."""
    stem = F.create_map(*[F.lit(x) for kv in CLEARS.items() for x in kv])[F.col("kind")]
    return events.withColumn("_stem", stem).where("_stem is not null").select(F.concat_ws(":", "_stem", F.col("device_id").cast("string")).alias("dedup_key"), "ts")


class Alert:
    """One condition's alerts: an open one takes repeats; one resolved less than `again` seconds ago re-opens; else a new one begins.

    A repeat raises the severity and replaces the impact if it has one, or, if it names another root cause, is folded under that and takes its severity, title and
    detail. An operator acknowledges an open alert or ends any by hand. Evidence (source and time of day) is kept for the first
    MOST_EVIDENCE steps; a re-opening and an end by hand are always noted. A re-opened alert isn't announced yet, and keeps its severity and title.
    """

    MOST_EVIDENCE = 20

    def __init__(self, again: float = 1800) -> None:
        self.again, self.n, self.evidence, self.state = again, 0, [], None
        self.opened = self.updated = self.resolved = self.root = None
        self.occurrences = self.severity = self.reopened = 0
        self.notified = False
        self.title = self.detail = self.impact = None

    def step(self, t: float, action: str, severity: int, source: str, root: str | None, title: str | None = None, detail: str | None = None, impact: str | None = None) -> tuple:
        """The current alert after an action: raise, resolve, notified (announced), or an operator's ack or manual (source: their name)."""
        at = f"{int(t) // 3600 % 24:02d}:{int(t) // 60 % 60:02d}:{int(t) % 60:02d}"
        mark = f"{source} {at}"
        if action == "raise":
            if self.n and self.resolved is None:
                self._repeat(severity, root, title, detail, impact)
                self._note(mark)
            elif self.n and t - self.resolved < self.again:
                self.resolved, self.notified, self.state = None, False, "open"
                self.reopened += 1
                self.occurrences += 1
                self.evidence.append(mark + " (re-opened)")
            else:
                self.n += 1
                self.opened, self.resolved, self.root, self.notified, self.state = t, None, root, False, "open"
                self.occurrences, self.severity, self.reopened, self.evidence = 1, severity, 0, [mark]
                self.title, self.detail, self.impact = title, detail, impact
            self.updated = t
        elif action == "resolve" and self.n and self.resolved is None:
            self.resolved = self.updated = t
            self.state = "resolved"
            self._note("resolved: " + mark)
        elif action == "notified" and self.n:
            self.notified = True
        elif action == "ack" and self.n:
            self.state, self.updated = "acked" if self.state == "open" else self.state, t
        elif action == "manual" and self.n:
            self.resolved = self.updated = t
            self.state = "resolved"
            self.evidence.append(f"resolved manually by {mark}")
        return self.held()

    def held(self) -> tuple:
        return self.n, self.state, self.opened, self.updated, self.resolved, self.occurrences, self.severity, self.reopened, self.root, self.notified, self.title, self.detail, self.impact, list(self.evidence)

    def restore(self, held: tuple) -> None:
        self.n, self.state, self.opened, self.updated, self.resolved, self.occurrences, self.severity, self.reopened, self.root, self.notified, self.title, self.detail, self.impact, evidence = held
        self.evidence = list(evidence)

    def _repeat(self, severity: int, root: str | None, title: str | None, detail: str | None, impact: str | None) -> None:
        self.occurrences += 1
        self.severity = max(self.severity, severity)
        self.impact = impact or self.impact
        if root is not None and root != self.root:
            self.root, self.severity, self.title, self.detail = root, severity, title, detail

    def _note(self, mark: str) -> None:
        if len(self.evidence) < self.MOST_EVIDENCE:
            self.evidence.append(mark)


UPSERTED = "_k int, state string, opened double, updated double, resolved double, occurrences int, severity int, reopened int, root_cause string, notified boolean, title string, detail string, impact string, evidence array<string>"
ACTION = ("t", "n", "action", "severity", "source", "root_cause", "title", "detail", "impact")


def with_texts(actions: DataFrame) -> DataFrame:
    """Actions with title, detail and impact, null where they have none."""
    return actions.select("dedup_key", *[F.col(c) if c in actions.columns else F.lit(None).cast("string").alias(c) for c in ACTION])


def upsert_alerts(actions: DataFrame, again: float = 1800) -> DataFrame:
    """Alerts of each dedup key (n: its number) after its actions: dedup_key, t seconds, n for ties, action, severity rank, source, root_cause, and title, detail and impact if there.

    The fold gives the alert's state at each action; the last one of each alert counts. evidence is an array.
    """
    rows = with_texts(actions).withColumn("t", F.col("t").cast("double")).withColumnsRenamed({c: f"_{c}" for c in ACTION if c != "t"})
    states = scan(rows, ["dedup_key"], ["t", "_n"], ["t", *[f"_{c}" for c in ACTION[2:]]], lambda: Alert(again).step, UPSERTED).where("_k > 0")
    value = [f.split()[0] for f in UPSERTED.split(", ")[1:]]
    last = states.groupBy("dedup_key", F.col("_k").alias("n")).agg(F.max_by(F.struct(*value), F.struct("t", "_n")).alias("x"))
    return last.select("dedup_key", "n", "x.*")


class Family:
    """The alerts of a root cause and those folded under it, over time.

    Rows: t, n, id, kind, limit (seconds, null without). raise opens an alert or updates it; one that hasn't been updated for longer than its limit ends by itself (timed) at
    that moment. A child (id other than the root's) ends (root) as soon as its root's alert is resolved or unknown, and its own device is up (kinds up, down). A
    raise less than `again` seconds after the end re-opens the alert, which keeps `opened`; older ones are forgotten, but for whether the device is up.
    """

    def __init__(self, root: int, again: float = 1800) -> None:
        self.root, self.again, self.of = root, again, {}

    def load(self, held: list[tuple]) -> None:
        self.of = {k: list(v) for k, *v in held}  # opened, updated, resolved, limit, occurrences, up

    def dump(self) -> list[tuple]:
        return [(k, *v) for k, v in sorted(self.of.items())]

    def _ends(self) -> list[tuple[float, int]]:
        return sorted((v[1] + v[3], k) for k, v in self.of.items() if v[0] is not None and v[2] is None and v[3] is not None)

    def due(self) -> float | None:
        ends = self._ends()
        return ends[0][0] + 0.001 if ends else None

    def _resolve(self, k: int, t: float, reason: str) -> list[tuple]:
        v = self.of[k]
        v[2] = t
        return [(k, v[0], t, reason, v[4])]

    def _free(self, t: float) -> list[tuple]:
        top = self.of.get(self.root)
        if top and top[0] is not None and top[2] is None:
            return []
        return [x for k, v in sorted(self.of.items()) if k != self.root and v[0] is not None and v[2] is None and v[5] for x in self._resolve(k, t, "root")]

    def advance(self, t: float) -> list[tuple]:
        """What ends by itself before t."""
        out: list[tuple] = []
        while (ends := self._ends()) and ends[0][0] < t:
            out += self._resolve(ends[0][1], ends[0][0], "timed") + self._free(ends[0][0])
        for v in self.of.values():
            if v[2] is not None and v[2] + self.again < t:
                v[:5] = None, None, None, None, 0
        return out

    def step(self, t: float, n: int, k: int, kind: str, limit: float | None) -> list[tuple]:
        v = self.of.setdefault(k, [None, None, None, None, 0, False])
        if kind != "raise":
            v[5] = kind == "up"
        else:
            fresh = v[0] is None or (v[2] is not None and t - v[2] >= self.again)
            v[:5] = t if fresh else v[0], t, None, limit, 1 if fresh else v[4] + 1
        return self._free(t)


FAMILY_ROW = "t double, n long, id long, kind string, lasts double"
ENDED = "id long, opened double, resolved double, reason string, occurrences int"


def ended_alerts(rows: DataFrame, horizon: float, again: float = 1800) -> DataFrame:
    """family, and ENDED: each end of an alert before `horizon` (seconds), by Family, over rows (family: the root's id, then FAMILY_ROW)."""
    last = rows.select("family").distinct().select("family", F.lit(float(horizon)).alias("t"), F.lit((1 << 62)).alias("n"), F.lit(None).cast("long").alias("id"), F.lit("end").alias("kind"), F.lit(None).cast("double").alias("lasts"))
    fields = [f.split()[0] for f in FAMILY_ROW.split(", ")]

    def start() -> Callable:
        family: list[Family] = []

        def step(key: int, t: float, n: int, k: float | None, kind: str, limit: float | None) -> list:
            if not family:
                family.append(Family(int(key), again))
            out = family[0].advance(t)
            if kind != "end":
                out += family[0].step(t, int(n), int(k), kind, None if limit is None or limit != limit else limit)
            return [dict(zip(("id", "opened", "resolved", "reason", "occurrences"), x)) for x in out]

        return step

    made = scan(rows.select("family", *fields).unionByName(last), ["family"], ["t", "n"], ["family", *fields], start, f"_ends array<struct<{ENDED.replace(' ', ': ')}>>".replace(",:", ","))
    return made.select("family", F.explode("_ends").alias("x")).select("family", "x.*")


def severity_by_role(df: DataFrame) -> DataFrame:
    """device_down is critical on core, router and firewall; a value past the rule's second threshold is major."""
    made = F.when((F.col("rule") == "device_down") & F.col("role").isin("core", "router", "firewall"), "critical").when(F.col("value") >= F.col("escalate"), "major").otherwise(F.col("severity"))
    return df.withColumn("severity", made)


def fold_children(alerts: DataFrame) -> DataFrame:
    """Root alerts with the number of alerts folded under them."""
    children = alerts.where("root_cause is not null").groupBy(F.col("root_cause").alias("id")).agg(F.count("*").alias("children"))
    return alerts.where("root_cause is null").join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def auto_resolved(alerts: DataFrame, rules: DataFrame, devices: DataFrame, now: int) -> DataFrame:
    """Open alerts that end by themselves, with the reason: `timed`, not updated for longer than their event rule's limit (cycles, in
    minutes); `root`, folded under an alert that is resolved or gone while their own device is up."""
    limits = F.broadcast(rules.where("object = 'event' and cycles > 0").select(F.col("id").alias("rule"), "cycles"))  # the rule table is a product's own
    live = alerts.where("state <> 'resolved'")
    timed = live.join(limits, "rule").where(F.lit(now) - epoch(F.col("updated_at")) > F.col("cycles") * 60).select("id", "rule", F.lit("timed").alias("reason"))
    held = alerts.where("state <> 'resolved'").select(F.col("id").alias("root_cause"))
    freed = live.where("root_cause is not null").join(held, "root_cause", "left_anti").join(devices.where("status = 'up'").select("device_id"), "device_id", "left_semi")
    return timed.unionByName(freed.join(timed.select("id"), "id", "left_anti").select("id", "rule", F.lit("root").alias("reason")))


def archive_split(alerts: DataFrame, now: int, age: int = 86400) -> tuple[DataFrame, DataFrame]:
    """Live alerts, and those resolved more than `age` ago."""
    old = F.coalesce((F.col("state") == "resolved") & (F.lit(now) - epoch(F.col("resolved_at")) > age), F.lit(False))
    return alerts.where(~old), alerts.where(old)


def all_alerts(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Both, an id once: the live row counts."""
    return live.unionByName(archived.join(live.select("id"), "id", "left_anti"))


def alert_list(alerts: DataFrame, state: str | None = None, least: str | None = None, site: int | None = None, roots: bool = False) -> DataFrame:
    """Filtered alerts: unresolved first, then by severity, then the newest."""
    from ..functions.columns import rank as r

    levels = {"critical": 4, "major": 3, "minor": 2, "info": 1}
    rows = alerts if state is None else alerts.where(F.col("state") == state)
    rows = rows if least is None else rows.where(r(F.col("severity")) >= levels[least])
    rows = rows if site is None else rows.where(F.col("site_id") == site)
    rows = rows.where("root_cause is null") if roots else rows
    return rows.orderBy(F.col("state") == "resolved", F.desc(r(F.col("severity"))), F.desc("opened_at"), "id")


def evidence(events: DataFrame, most: int = 20) -> DataFrame:
    """The first markers `source hh:mm:ss` of each key in order."""
    w = Window.partitionBy("dedup_key").orderBy("ts", "id")
    marker = F.concat_ws(" ", "source", F.date_format("ts", "HH:mm:ss"))
    rows = events.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most)
    return rows.groupBy("dedup_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", marker.alias("m")))), lambda x: x["m"]), ", ").alias("evidence"))


def acted_on(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """State after the last of an operator's actions (id, at, action): ack makes an open alert acked, resolve ends any that isn't."""
    last = actions.groupBy("id").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    made = F.when((F.col("action") == "ack") & (F.col("state") == "open"), "acked").when((F.col("action") == "resolve") & (F.col("state") != "resolved"), "resolved").otherwise(F.col("state"))
    return alerts.join(last, "id", "left").withColumn("state", made).drop("action")


def to_notify(alerts: DataFrame, now: int, least: str = "minor", resolved_too: bool = True, quiet: tuple[int, int] | None = None, critical_always: bool = True, group: int = 60, zone: str = "UTC") -> DataFrame:
    """Alerts of a batch that go out at a time (seconds), in their order (`place`: the severest first, then the oldest opened, then by id): severe enough (resolved ones only if announced before), outside quiet hours.

    Quiet hours are minutes of the day on the clock of `zone`, and may pass midnight; a column `zone` of the alerts, where not null, goes before it. Nothing goes
    out until the batch's oldest update is `group` seconds old, unless a critical alert waits in it that isn't resolved.
    """
    levels = {"critical": 4, "major": 3, "minor": 2, "info": 1}
    ended = F.col("state") == "resolved"
    waiting = alerts.agg(F.min(epoch(F.col("updated_at"))).alias("oldest"), F.coalesce(F.max((F.col("severity") == "critical") & ~ended), F.lit(False)).alias("urgent"))
    ready = waiting.where(F.col("urgent") | (F.lit(now) - F.col("oldest") >= group)).select(F.lit(True).alias("_ready"))
    ok = F.when(ended, F.lit(resolved_too) & F.col("notified")).otherwise(rank(F.col("severity")) >= levels[least])
    rows = alerts.where(ok)
    if quiet is not None:
        local = civil_time(F.lit(now), F.coalesce(F.col("zone"), F.lit(zone)) if "zone" in alerts.columns else F.lit(zone))
        minute = F.hour(local) * 60 + F.minute(local)
        inside = (minute >= quiet[0]) & (minute < quiet[1]) if quiet[0] <= quiet[1] else (minute >= quiet[0]) | (minute < quiet[1])
        rows = rows.where(~inside | ((F.col("severity") == "critical") & F.lit(critical_always)))
    rows = rows.withColumn("_ready", F.lit(True)).join(F.broadcast(ready), "_ready", "left_semi").drop("_ready")  # one row or none
    return _placed(rows)


def _placed(rows: DataFrame) -> DataFrame:
    """`place` of alerts, the severest first, then the oldest opened, then by id: numbers within a severity's minute, after the running counts of the minutes of a day and of the days before it."""
    minute = F.coalesce(F.floor(epoch(F.col("opened_at")) / 60), F.lit(-(1 << 40)))  # null stands first
    rows = rows.withColumns({"_level": -rank(F.col("severity")), "_minute": minute})
    minutes = rows.groupBy("_level", "_minute").agg(F.count("*").alias("_n")).withColumn("_day", F.floor(F.col("_minute") / 1440))
    days = minutes.groupBy("_level", "_day").agg(F.sum("_n").alias("_n"))
    upto = lambda *by: F.coalesce(F.sum("_n").over((Window.partitionBy(*by[0]) if by[0] else Window).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_level", "_day", upto([], ["_level", "_day"]).alias("_before"))
    minutes = minutes.select("_level", "_minute", "_day", upto(["_level", "_day"], ["_minute"]).alias("_inside"))
    starts = minutes.join(days, ["_level", "_day"]).select("_level", "_minute", (F.col("_before") + F.col("_inside")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_level", "_minute").orderBy("opened_at", "id"))
    made = rows.withColumn("_own", own).join(starts, ["_level", "_minute"])
    return made.withColumn("place", (F.col("_start") + F.col("_own")).cast("int")).drop("_level", "_minute", "_own", "_start")


def named_peers(interfaces: DataFrame, links: DataFrame, devices: DataFrame) -> DataFrame:
    """peer of each interface (device_id, name): device and port at the other end of a link that isn't stale, the smallest of several;
    an external end by its name. Port names match without case; null without a link."""
    names = devices.select(F.col("device_id").alias("_far"), F.col("name").alias("_name"))
    live = links.where("not stale")
    end = lambda near, far, label: live.select(F.col(f"{near}_device").alias("device_id"), F.lower(f"{near}_if").alias("_if"), F.col(f"{far}_device").alias("_far"), F.col(f"{far}_if").alias("_far_if"), label.alias("_label"))
    ends = end("a", "b", F.when(F.col("external"), F.col("external_name"))).unionByName(end("b", "a", F.lit(None).cast("string")))
    peer = F.concat_ws(" ", F.coalesce("_label", "_name"), "_far_if")
    known = ends.join(names, "_far", "left").where("_label is not null or _name is not null").groupBy("device_id", "_if").agg(F.min(peer).alias("peer"))
    return interfaces.withColumn("_if", F.lower("name")).join(known, ["device_id", "_if"], "left").drop("_if")


def link_status(links: DataFrame, interfaces: DataFrame) -> DataFrame:
    """A link is down if the interface at either end is; ends match by name without case."""
    side = lambda s: interfaces.select(F.col("device_id").alias(f"{s}_device"), F.lower("name").alias(f"_{s}"), F.col("oper_up").alias(f"{s}_up"))
    rows = links.withColumns({"_a": F.lower("a_if"), "_b": F.lower("b_if")}).join(side("a"), ["a_device", "_a"], "left").join(side("b"), ["b_device", "_b"], "left")
    made = F.when(~F.col("a_up") | ~F.col("b_up"), "down").when(F.coalesce("a_up", "b_up").isNull(), "unknown").otherwise("up")
    return rows.withColumn("status", F.coalesce(made, F.lit("unknown"))).drop("_a", "_b")
