"""Reports (R) and exports (X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import between, civil_time, epoch, since
from ..functions.joins import left_join
from .metrics import series_stats


def availability(devices: DataFrame, outages: DataFrame, start: int, stop: int) -> DataFrame:
    """Downtime of monitored devices in a window: outages clipped to it and added up (overlaps count twice), their number, the longest, and the percentage, from a device's creation on."""
    lo, hi = F.greatest("opened", F.lit(start)), F.least(F.coalesce("resolved", F.lit(stop)), F.lit(stop))
    cut = outages.where((F.col("opened") < stop) & (F.coalesce("resolved", F.lit(stop)) > start)).withColumn("s", F.greatest(hi - lo, F.lit(0)))
    sums = cut.groupBy("device_id").agg(F.sum("s").alias("down_s"), F.count("*").alias("incidents"), F.max("s").alias("longest_s"))
    span = F.lit(stop) - F.greatest("created", F.lit(start))
    rows = devices.join(sums, "device_id", "left")
    down = F.coalesce("down_s", F.lit(0))
    return rows.select("device_id", down.alias("down_s"), F.coalesce("incidents", F.lit(0)).alias("incidents"), F.coalesce("longest_s", F.lit(0)).alias("longest_s"), F.when(span > 0, F.round(F.greatest(F.lit(0.0), (span - down) / span * 100), 4)).otherwise(100.0).alias("availability"))


def availability_figures(table: DataFrame, least: float = 99.9) -> DataFrame:
    """Mean availability, number of devices below `least`, and number of devices of an availability table."""
    return table.agg(F.round(F.avg("availability"), 4).alias("average"), F.count_if(F.col("availability") < least).alias("below"), F.count("*").alias("devices"))


def alert_causes(alerts: DataFrame, start: int, stop: int) -> DataFrame:
    """Alerts opened in the window by rule, with their share, the mean and the upper median time to resolve.

    The upper median of n sorted values is number floor(n / 2) + 1. It comes from running counts of the distinct values, so
    a rule with many alerts isn't sorted in one place.
    """
    rows = alerts.where(between("opened_at", start, stop - 1)).withColumn("ttr", epoch(F.col("resolved_at")) - epoch(F.col("opened_at")))
    by = rows.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("ttr"), 6).alias("mean_s"), F.count("ttr").alias("known"))
    values = rows.where("ttr is not null").groupBy("rule", "ttr").agg(F.count("*").alias("c"))
    upto = values.withColumn("upto", F.sum("c").over(Window.partitionBy("rule").orderBy("ttr")))
    median = upto.join(by.select("rule", "known"), "rule").where(F.col("upto") >= F.floor(F.col("known") / 2) + 1).groupBy("rule").agg(F.min("ttr").alias("median_s"))
    whole = rows.agg(F.count("*").alias("whole"))
    out = by.join(median, "rule", "left").join(F.broadcast(whole), F.lit(True))
    return out.select("rule", "n", F.round(F.col("n") / F.col("whole") * 100, 6).alias("share_pct"), "mean_s", "median_s")


def alert_severities(alerts: DataFrame, start: int, stop: int) -> DataFrame:
    """Alerts opened in the window by severity."""
    return alerts.where(between("opened_at", start, stop - 1)).groupBy("severity").agg(F.count("*").alias("n"))


def noisiest(alerts: DataFrame, n: int = 15) -> DataFrame:
    return alerts.groupBy("device_id").agg(F.count("*").alias("alerts"), F.sum("occurrences").alias("occurrences")).orderBy(F.desc("alerts"), F.desc("occurrences"), "device_id").limit(n)


def busiest(series: DataFrame, interfaces: DataFrame, n: int = 25) -> DataFrame:
    """Ports and directions with the highest peak: mean and peak of each series (device_id, if_index, dir, v, max) in percent of the
    port's speed, of ports whose speed is known; the peak is shown up to 100."""
    stats = series_stats(series, ["device_id", "if_index", "dir"])
    ports = interfaces.where("speed_mbps > 0").select("device_id", "if_index", (F.col("speed_mbps") * 1_000_000).alias("_full"))
    rows = stats.join(ports, ["device_id", "if_index"]).withColumns({"avg_pct": F.round(F.col("mean") * 100 / F.col("_full"), 6), "_peak": F.col("peak") * 100 / F.col("_full")})
    top = rows.orderBy(F.desc("_peak"), "device_id", "if_index", "dir").limit(n)
    return top.select("device_id", "if_index", "dir", "avg_pct", F.round(F.least("_peak", F.lit(100.0)), 6).alias("peak_pct"))


def device_load(stats: DataFrame, n: int = 25) -> DataFrame:
    """CPU and memory of each device side by side (device_id, metric, mean, peak), the n with the highest CPU peak."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = stats.groupBy("device_id").agg(pick("cpu", "mean").alias("cpu_mean"), pick("cpu", "peak").alias("cpu_peak"), pick("mem", "mean").alias("mem_mean"), pick("mem", "peak").alias("mem_peak"))
    return wide.orderBy(F.desc_nulls_last("cpu_peak"), "device_id").limit(n)


def inventory(devices: DataFrame) -> DataFrame:
    return devices.groupBy("vendor", "role").agg(F.count("*").alias("devices"), F.count_if("monitored").alias("monitored"))


def changes(events: DataFrame, start: int, stop: int, n: int = 200, kinds: tuple[str, ...] = ("config_changed", "device_rebooted", "neighbor_changed")) -> DataFrame:
    """The newest configuration changes, reboots and changes of neighbours of a window."""
    return events.where(F.col("kind").isin(*kinds) & between("ts", start, stop - 1)).orderBy(F.desc("ts"), F.desc("id")).limit(n)


def stored_versions(versions: DataFrame, devices: DataFrame, start: int) -> DataFrame:
    """Configuration versions (device_id, version, ts, source, added, removed) stored since start that changed a line, with the device's name, newest first."""
    rows = versions.where(since("ts", start) & (F.col("added") + F.col("removed") > 0))
    return rows.join(devices.select("device_id", F.col("name").alias("device")), "device_id").orderBy(F.desc("ts"), "device_id", "version")


def endpoints_per_switch(rows: DataFrame) -> DataFrame:
    """Placed endpoints of each switch."""
    return rows.where("device_id is not null").groupBy("device_id").agg(F.count("*").alias("endpoints"))


def endpoint_report(rows: DataFrame, start: int, n: int = 20) -> DataFrame:
    """Vendors with the most endpoints, and how many of each are new since start."""
    return rows.groupBy("vendor").agg(F.count("*").alias("endpoints"), F.count_if(F.col("first") >= start).alias("new")).orderBy(F.desc("endpoints"), "vendor").limit(n)


def due(reports: DataFrame, now: int) -> DataFrame:
    """Reports whose schedule fires at this minute: their hour, not within 23 hours of the last run, Mondays for weekly, the 1st for monthly.

    Hours and days are those of the report's own time zone (`zone`, a column that may be missing or null: UTC). An hour that the clock skips in spring doesn't
    come that day; one that it repeats in autumn comes once, as 23 hours must lie between runs.
    """
    zone = F.coalesce(F.col("zone"), F.lit("UTC")) if "zone" in reports.columns else F.lit("UTC")
    t = civil_time(F.lit(now), zone)
    day = F.when(F.col("schedule") == "daily", True).when(F.col("schedule") == "weekly", F.dayofweek(t) == 2).when(F.col("schedule") == "monthly", F.dayofmonth(t) == 1).otherwise(False)
    return reports.where((F.hour(t) == F.col("hour")) & (F.minute(t) == 0) & (F.col("last_run").isNull() | (F.lit(now) - F.col("last_run") >= 23 * 3600)) & day)


# ---- exports


def findings(alerts: DataFrame, devices: DataFrame, sites: DataFrame, interfaces: DataFrame, probes: DataFrame) -> DataFrame:
    """Alerts as findings: severity on five levels, the dedup key as fingerprint, a readable target, status, group and an evidence map without empty values.

    The target is the device's name and address. An object that is a probe (object, name, target, type) stands in for a
    missing device by its target, one that is an interface (object, name, alias) adds its name; else the object alone is the target.
    """
    d = devices.select("device_id", F.col("name").alias("_n"), F.col("ip").alias("_ip"))
    s = sites.select("site_id", F.col("name").alias("_site"))
    i = interfaces.select("object", F.nullif("name", F.lit("")).alias("_if"), F.nullif("alias", F.lit("")).alias("_alias"))
    p = probes.select("object", F.col("name").alias("_probe"), F.col("target").alias("_to"), F.col("type").alias("_type"))
    rows = left_join(left_join(alerts, "device_id", d).join(s, "site_id", "left"), "object", p, i)
    level = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "major", "high").when(F.col("severity") == "minor", "medium").when(F.col("severity") == "info", "info").otherwise("low")
    name, ip, ident = F.nullif(F.col("_n"), F.lit("")), F.nullif(F.col("_ip"), F.lit("")), F.col("device_id").cast("string")
    device = F.coalesce(F.when(name != ip, F.concat(name, F.lit(" ("), ip, F.lit(")"))), name, ip, F.when(F.col("_probe").isNull(), ident))
    port = F.when(F.col("_probe").isNull(), F.col("_if"))
    target = F.coalesce(F.nullif(F.concat_ws(" ", F.coalesce(device, F.col("_to")), port), F.lit("")), F.col("object"))
    facts = {"rule": F.col("rule"), "occurrences": F.col("occurrences").cast("string"), "object": F.col("object"), "device_ip": ip, "device": name, "site": F.col("_site"), "probe": F.col("_probe"), "probe_target": F.col("_to"), "probe_type": F.col("_type"), "interface": port, "interface_alias": F.when(port.isNotNull(), F.col("_alias"))}
    evidence = F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & (v != ""))
    key = F.coalesce(F.nullif(F.col("dedup_key"), F.lit("")), F.col("id").cast("string"))
    return rows.select("id", key.alias("fingerprint"), F.concat(F.lit("check."), F.col("rule")).alias("check"), target.alias("target"), level.alias("severity"), F.when(F.col("state") == "acked", "acknowledged").otherwise(F.col("state")).alias("status"), F.coalesce("_site", F.col("site_id").cast("string")).alias("group"), evidence.alias("evidence"))


def finding_changes(versions: DataFrame) -> DataFrame:
    """What a feed reports of alerts (id, seq and their columns, one row for each stored state): opened at first sight or after an end, resolved, changed if anything but
    seq differs from the state before; nothing otherwise. An alert first seen resolved isn't reported."""
    facts = F.xxhash64(*[c for c in versions.columns if c not in ("id", "seq")])
    w = Window.partitionBy("id").orderBy("seq")
    rows = versions.withColumn("_now", facts).withColumns({"_was": F.lag("state").over(w), "_then": F.lag("_now").over(w)})
    return rows.withColumn("change", change_of(F.col("_was"), F.col("state"), F.col("_now") == F.col("_then"))).where("change is not null").drop("_now", "_was", "_then")


def change_of(was: Column, state: Column, same: Column) -> Column:
    live = state != "resolved"
    return F.when(live & F.coalesce(was == "resolved", F.lit(True)), "opened").when(~live & (was != "resolved"), "resolved").when(live & ~same, "changed")


#: What marks a key as secret, and the bounds of evidence.
SECRET = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "private", "credential", "cookie", "session", "authorization", "bearer", "license_key", "licence_key", "signature")
MOST_KEYS, MOST_CHARS, MOST_ITEMS, MOST_DEPTH = 24, 400, 12, 3
TOO_DEEP, WITHHELD = "[omitted: nested too deep]", "[omitted: instruction-like text]"
#: What a text that gives orders to a reader model says. Verbs that drop what it was told, with what stands near them and what is dropped.
DROPS, ITS, TOLD = ("ignore", "disregard", "forget", "override", "bypass"), ("previous", "prior", "earlier", "above", "all", "any", "every", "your", "the", "these"), ("instruction", "instructions", "rule", "rules", "prompt", "prompts", "guideline", "guidelines")
#: Verbs that decide a finding, and the verdicts that follow "as" or "to".
DECIDES, VERDICTS = ("mark", "set", "treat", "report", "classify", "rate"), ("resolved", "fixed", "closed", "safe", "harmless", "info", "informational", "low", "medium", "high", "critical")
#: Verbs that dictate an answer, and roles of a conversation.
ANSWERS, ROLES = ("respond", "reply", "answer", "output", "print", "return"), ("system", "user", "assistant")
#: Phrases that give another role, everywhere and as an order; marks of chat templates.
SAYS, ORDERS = ("system prompt", "developer message", "you are now", "new instruction", "new instructions", "from now on"), ("act as", "pretend to be", "pretend you are")
MARKS = ("im_start", "im_end", "endoftext", "eot_id", "start_header_id", "end_header_id")
#: Words before an order within a sentence.
LEADS = ("and", "then", "please", "now", "must", "should", "you", "always", "to", "just")


def _orders() -> str:
    """One expression for all of that. Distances are words of one sentence; an answer is dictated and a role given by a verb that begins a sentence or follows one of LEADS."""
    any_of = lambda words: rf"(?:{'|'.join(words)})"
    gap = r"[^\w.!?;\n]+"
    within = lambda n: rf"(?:{gap}\w+){{0,{n}}}{gap}"
    begins = rf"(?:^|[.!?;\n]\W*|\b{any_of(LEADS)}{gap})"
    drops = rf"\b{any_of(DROPS)}{within(2)}{any_of(ITS)}{within(3)}{any_of(TOLD)}\b"
    decides = rf"\b{any_of(DECIDES)}{within(12)}(?:as|to){gap}{any_of(VERDICTS)}\b"
    answer = rf"{any_of(ANSWERS[:3])}(?:{gap}(?:only|exactly))?{gap}with\b"
    output = rf"{any_of(ANSWERS[3:])}(?:{gap}(?:exactly\b|only\b(?!{gap}(?:if|when)\b))|{within(2)}json\b)"
    says = rf"\b{any_of(SAYS)}\b"
    forged = rf"<{any_of(MARKS)}>|<[|]{any_of(MARKS + ROLES)}[|]>|\b{any_of(ROLES)}[ \t]*:[ \t]*[{{]"
    return f"(?i){drops}|{decides}|{begins}(?:{answer}|{output}|{any_of(ORDERS)}\\b)|{says}|{forged}"


INSTRUCTION = _orders()


def reads_as_instruction(text: Column) -> Column:
    """Whether a text orders a reader about: one sentence drops what it was told, gives a finding's verdict, dictates the answer or
    another role, or the text forges a turn of the conversation. Words in their usual places in logs and banners don't count."""
    return text.rlike(INSTRUCTION)


def withheld(text: Column) -> Column:
    """The text, or a note in its place if any of it reads as an instruction."""
    return F.when(reads_as_instruction(text), WITHHELD).otherwise(text)


def _kept(key: Column) -> Column:
    return ~F.lower(key).rlike("|".join(SECRET))


def _cut(text: Column) -> Column:
    return F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS), F.lit("…"))).otherwise(text)


def sanitise_flat(evidence: Column) -> Column:
    """A map of strings without secret keys: the first keys in order, texts withheld or cut."""
    safe = F.map_filter(evidence, lambda k, v: _kept(k))
    keys = F.slice(F.array_sort(F.map_keys(safe)), 1, MOST_KEYS)
    return F.transform_values(F.map_filter(safe, lambda k, v: F.array_contains(keys, k)), lambda k, v: _cut(withheld(v)))


def sanitise_json(df: DataFrame, column: str) -> DataFrame:
    """Nested JSON, bounded and without secrets at every level, as compact JSON with sorted keys; text that isn't an object, or of which nothing is left, becomes null.

    Values are variants; a value's kind decides at each of the MOST_DEPTH levels, which are written out, so all stays in the JVM.
    """

    def clean(v: Column, depth: int) -> Column:
        kind = F.schema_of_variant(v)
        text = _cut(withheld(v.cast("string"))).cast("variant")
        if depth > MOST_DEPTH:
            nested = F.lit(TOO_DEEP).cast("variant")
            return F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), nested).when(kind == "STRING", text).otherwise(v)
        items = F.transform(F.slice(v.cast("array<variant>"), 1, MOST_ITEMS), lambda x: clean(x, depth + 1))
        return F.when(F.startswith(kind, F.lit("OBJECT")), members(v, depth)).when(F.startswith(kind, F.lit("ARRAY")), items.cast("variant")).when(kind == "STRING", text).otherwise(v)

    def members(v: Column, depth: int) -> Column:
        entries = v.cast("map<string,variant>")
        keys = F.slice(F.array_sort(F.filter(F.map_keys(entries), _kept)), 1, MOST_KEYS)
        made = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), clean(F.element_at(entries, k), depth + 1).alias("value"))))
        return F.when(F.size(keys) > 0, F.to_variant_object(made))

    parsed = F.try_parse_json(column)
    whole = F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), members(parsed, 1))
    return df.withColumn(column, F.to_json(whole))


def alert_facts(alerts: DataFrame, devices: DataFrame, sites: DataFrame, now: int) -> DataFrame:
    """What is known of each alert: duration or age, its root's title, and its detail unless a log line or trap raised it."""
    roots = alerts.select(F.col("id").alias("root_cause"), F.col("title").alias("root_title"))
    rows = left_join(alerts, "root_cause", roots).join(devices.select("device_id", F.col("name").alias("device")), "device_id", "left").join(sites.select("site_id", F.col("name").alias("site")), "site_id", "left")
    t = epoch(F.col("opened_at"))
    from_text = F.exists("evidence", lambda x: x.startswith("syslog ") | x.startswith("trap "))
    return rows.select("id", "device", "site", "root_title", F.when(F.col("state") == "resolved", epoch(F.col("resolved_at")) - t).alias("duration_s"), F.when(F.col("state") != "resolved", F.lit(now) - t).alias("open_s"), F.when(~from_text, F.col("detail")).alias("detail"))


def redacted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Secrets that are set read as four dots."""
    return df.withColumns({c: F.when(F.col(c) != "", F.lit("••••")).otherwise(F.col(c)) for c in columns})
