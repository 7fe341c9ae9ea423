"""Logs, traps and events: parsing, time repair, classification, suppression and search (L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import between, epoch
from ..functions.folds import Gap, scan

#: Levels of key=value lines.
LEVELS = {"emergency": 0, "alert": 1, "critical": 2, "error": 3, "warning": 4, "notice": 5, "information": 6}
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: The old line head: a counter, a clock mark, month, day and time, then a fraction, a zone and a colon, as far as they are there.
_CLOCK = r"\d\d(?::\d\d){2}"
_OLD_HEAD = rf"^(?:\d+:\s)?[*.]?((?:{'|'.join(_MONTHS)})\s{{1,2}}\d\d?\s{_CLOCK})(?:\.\d+)?(?:\s[A-Z]{{2,5}}(?=[:\s]|$))?:?\s?"


def word_after(text: Column, phrase: str, shape: str = r"\S+", between: str = " ", case: bool = False) -> Column:
    """What fits `shape` behind a phrase and the signs `between`, at the first place where something does, cut where it ends to fit; null without one."""
    found = F.regexp_extract(text, f"{'' if case else '(?i)'}{phrase}{between}({shape})", 1)
    return F.when(found != "", found)


def pairs(text: Column) -> Column:
    """key=value pairs as a map, quotes dropped, of equal keys the last."""
    pair = F.lit(r'(\w+)=(?:"([^"]*)"|([^\s"]\S*))')
    keys, quoted, bare = (F.regexp_extract_all(text, pair, F.lit(i)) for i in (1, 2, 3))
    entries = F.arrays_zip(keys.alias("k"), F.zip_with(quoted, bare, lambda q, w: F.concat(q, w)).alias("v"))
    last = lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i))
    return F.map_from_entries(F.filter(entries, last))


def computed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: what is computed so far is computed once, and later filters aren't rewritten in its terms."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def parse_lines(df: DataFrame) -> DataFrame:
    """raw, host, recv -> facility, severity, mnemonic, message, kv, ts. Never fails: what doesn't parse is an info-level message.

    A line begins with its priority in angle brackets. Then either version 1, time, host, application, process, message id and structured
    data (a dash or brackets) come, parted by single spaces, or the old head with month, day and time, or neither.
    """
    raw = F.regexp_replace("raw", r"[\r\n\x00]+$", "")
    mark = F.substring_index(F.substring("_raw", 2, 5), ">", 1)
    rows = df.withColumn("_raw", raw).withColumn("_pri", F.when(F.col("_raw").startswith("<") & mark.rlike(r"^\d{1,3}$") & (F.instr("_raw", ">") == F.length(mark) + 2), mark).cast("int"))
    rows = rows.withColumn("_rest", F.when(F.col("_pri").isNotNull(), F.expr("substring(_raw, instr(_raw, '>') + 1)")).otherwise(F.col("_raw")))
    rows = rows.withColumn("_f", F.when(F.col("_rest").startswith("1 "), F.split("_rest", " ", 7)))
    whole = (F.size("_f") == 7) & ~F.array_contains(F.slice("_f", 1, 6), "")
    data = F.get("_f", F.lit(6))
    tail = F.when(data.startswith("-"), F.substring(data, 2, F.length(data))).when(data.startswith("[") & (F.instr(data, "]") > 0), F.substring(data, F.instr(data, "]") + 1, F.length(data)))
    rows = rows.withColumn("_new", F.coalesce(whole & tail.isNotNull(), F.lit(False)))
    rows = rows.withColumn("_time", F.when(~F.col("_new"), F.nullif(F.regexp_extract("_rest", _OLD_HEAD, 1), F.lit(""))))
    rows = computed(rows)
    rows = rows.withColumn("message", F.trim(F.when(F.col("_new"), tail).when(F.col("_time").isNotNull(), F.regexp_replace("_rest", _OLD_HEAD, "")).otherwise(F.col("_rest"))))
    rows = computed(rows).withColumn("_code", vendor_code(F.col("message")))
    rows = rows.withColumn("kv", F.when(F.col("_code").isNull() & F.col("message").contains("logid="), pairs(F.col("message"))))
    rows = computed(rows)
    kv = lambda k: F.coalesce(F.col("kv")[k], F.lit(""))
    app = F.get("_f", F.lit(3))
    vendor = F.concat(F.lit("FGT-"), kv("type"), F.lit("-"), kv("subtype"), F.when(kv("logdesc") != "", F.concat(F.lit("-"), F.replace(F.upper(kv("logdesc")), F.lit(" "), F.lit("_")))).otherwise(""))
    level = F.create_map(*[F.lit(x) for kv_ in LEVELS.items() for x in kv_])[kv("level")]
    rows = rows.withColumn("mnemonic", F.coalesce("_code", F.when(kv("logid") != "", vendor), F.when(F.col("_new") & (app != "-"), app), F.lit("")))
    rows = rows.withColumn("severity", F.coalesce(F.split_part("_code", F.lit("-"), F.lit(2)).try_cast("int"), level, F.col("_pri") % 8, F.lit(6)).cast("int"))
    rows = rows.withColumn("facility", F.coalesce(F.floor(F.col("_pri") / 8), F.lit(1)).cast("int"))
    rows = rows.withColumn("ts", repaired_time(F.when(F.col("_new"), F.try_to_timestamp(F.get("_f", F.lit(1))).cast("timestamp_ntz")), F.col("_time"), F.col("recv")))
    return computed(rows.select(*[c for c in df.columns if c != "raw"], "facility", "severity", "mnemonic", "message", "kv", "ts"))


def vendor_code(message: Column) -> Column:
    """FACILITY-level-NAME of the first %FACILITY-level-NAME: in a message, in capitals; null without one."""
    parts = F.split(message, "%")
    codes = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.when(x.contains(":"), F.substring_index(x, ":", 1)))
    fits = lambda x: x.isNotNull() & (F.size(F.split(x, "-")) == 3) & (F.length(F.split_part(x, F.lit("-"), F.lit(2))) == 1) & x.rlike("^[A-Z0-9_-]+$") & F.split_part(x, F.lit("-"), F.lit(2)).between("0", "9") & ~x.startswith("-") & ~x.endswith("-")
    return F.get(F.filter(codes, fits), F.lit(0))


def repaired_time(stamped: Column, bsd: Column, recv: Column) -> Column:
    """The sender's time, or the receive time where there is none or it is over 5 minutes ahead or a day behind.

    A time without year takes the year of arrival, the one before if it is over 48 hours ahead.
    """
    day = F.regexp_replace(bsd, " +", " ")
    this = F.try_to_timestamp(F.concat(F.year(recv).cast("string"), F.lit(" "), day), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    back = F.try_to_timestamp(F.concat((F.year(recv) - 1).cast("string"), F.lit(" "), day), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    own = F.coalesce(stamped, F.when(epoch(this) - epoch(recv) > 48 * 3600, back).otherwise(this))
    ahead = own.cast("timestamp").cast("double") - recv.cast("timestamp").cast("double")
    return F.when(own.isNull() | (ahead > 300) | (ahead < -86400), recv).otherwise(own)


def known_sources(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Device of each line's host; null if the host isn't in the inventory."""
    return df.join(devices.select(F.col("device_id").alias("host"), F.col("name").alias("device")), "host", "left")


def unknown_sources(df: DataFrame, devices: DataFrame) -> DataFrame:
    return df.join(devices.select(F.col("device_id").alias("host")), "host", "left_anti").groupBy("host").agg(F.count("*").alias("lines"))


def classify(df: DataFrame) -> DataFrame:
    """At most one event for each line (mnemonic, message, severity, device_id): kind, event_severity, subject, dedup_key. The first family that fits counts."""
    up, msg = F.upper("mnemonic"), F.col("message")
    low, port = F.lower(msg), word_after(msg, "interface", "[a-z-]+[0-9][0-9/.:]*")
    has = lambda text, *parts: F.greatest(*[F.instr(text, p) for p in parts], F.lit(0)) > 0
    link = (up.startswith("LINK-") | up.startswith("LINEPROTO-")) & has(up, "UPDOWN")
    config = has(up, "CONFIG_I", "CFGLOG_LOGGEDCMD", "CONFIG-CHANGE") | has(low, "configuration changed", "config changed")
    bgp = up.startswith("BGP-") & has(up, "ADJCHANGE")
    ospf = up.startswith("OSPF-") & has(up, "ADJCHG")
    auth = has(up, "LOGIN_FAILED", "AUTHFAIL") | has(low, "authentication failed", "login failed")
    ha = has(up, "-HA-", "HA_STATE") | has(low, "ha state changed", "failover")
    env = has(up, "ENVMON", "ENVIRONMENT", "PLATFORM_ENV", "-FAN-", "-PSU-", "POWER_SUPPLY")
    vpn = has(up, "VPN") & has(low, "down", "tunnel")
    critical = F.col("severity") <= 2
    down = {"link": has(low, "to down"), "bgp": has(msg, "Down") | has(low, " down"), "ospf": has(msg, "to DOWN")}
    family = F.when(link, "link").when(config, "config").when(bgp, "bgp").when(ospf, "ospf").when(auth, "auth").when(ha, "ha").when(env, "env").when(vpn, "vpn").when(critical, "critical")
    rows = computed(df.withColumn("_family", family)).where(F.col("_family").isNotNull())
    fam = F.col("_family")
    pick = lambda *cases: F.coalesce(*[F.when(test, value if isinstance(value, Column) else F.lit(value)) for test, value in cases])
    kind = pick((fam == "link", F.when(down["link"], "link_down").otherwise("link_up")), (fam == "config", "config_changed"), (fam == "bgp", F.when(down["bgp"], "bgp_neighbor_down").otherwise("bgp_neighbor_up")), (fam == "ospf", F.when(down["ospf"], "ospf_adjacency_down").otherwise("ospf_adjacency_up")), (fam == "auth", "auth_failure"), (fam == "ha", "ha_state_change"), (fam == "env", "environment_fault"), (fam == "vpn", "vpn_tunnel_change"), (fam == "critical", "critical_log"))
    major = F.col("kind").isin("link_down", "bgp_neighbor_down", "ospf_adjacency_down", "ha_state_change", "critical_log") | ((F.col("kind") == "environment_fault") & (F.col("severity") < 5))
    severity = F.when(major, "major").when(F.col("kind").isin("config_changed", "vpn_tunnel_change"), "minor").otherwise("info")
    who = F.coalesce(word_after(msg, r"configured from \S+ by"), word_after(msg, "user", r"[\w.@-]+", "[:= ]+'?"))
    subject = pick((fam == "link", port), (fam == "config", who), (fam == "bgp", word_after(msg, "neighbor", "[0-9A-Fa-f.:]+", case=True)), (fam == "auth", word_after(msg, "(?:from|by)", "[0-9.]+")))
    rows = computed(rows.withColumn("kind", kind).withColumn("subject", subject)).withColumn("event_severity", severity).where((fam != "link") | F.col("subject").isNotNull())
    dev = F.col("device_id").cast("string")
    key = pick((fam == "link", F.concat_ws(":", "kind", dev, "subject")), (fam == "config", F.concat_ws(":", F.lit("config_changed"), dev, F.date_format("recv", "yyyyMMddHHmm"))), (fam == "bgp", F.concat_ws(":", F.lit("bgp"), dev, F.coalesce("subject", F.lit("")))), (fam == "auth", F.concat_ws(":", F.lit("auth_failure"), dev)), (fam == "critical", F.concat_ws(":", F.lit("critical_log"), dev, "mnemonic")), (F.lit(True), F.concat_ws(":", fam, dev)))
    return rows.withColumn("dedup_key", key).drop("_family")


#: The standard trap ids.
TRAPS = {"1.3.6.1.6.3.1.1.5.1": "coldStart", "1.3.6.1.6.3.1.1.5.2": "warmStart", "1.3.6.1.6.3.1.1.5.3": "linkDown", "1.3.6.1.6.3.1.1.5.4": "linkUp", "1.3.6.1.6.3.1.1.5.5": "authenticationFailure"}


def classify_traps(df: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Kind, severity and label of traps by their id or its prefix; link traps name their interface."""
    oid = F.col("oid")
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in TRAPS.items() for x in kv])[oid], oid)
    link = F.col("trap").isin("linkDown", "linkUp")
    bgp = oid.startswith("1.3.6.1.2.1.15.7")
    kind = F.when(F.col("trap") == "linkDown", "link_down").when(F.col("trap") == "linkUp", "link_up").when(F.col("trap").isin("coldStart", "warmStart"), "device_rebooted").when(F.col("trap") == "authenticationFailure", "auth_failure").when(bgp & oid.endswith(".2"), "bgp_neighbor_down").when(bgp, "bgp_neighbor_up").when(oid.startswith("1.3.6.1.4.1.9.9.13.3"), "environment_fault").otherwise("vendor_trap")
    severity = F.when(F.col("kind").isin("link_down", "device_rebooted", "bgp_neighbor_down", "environment_fault"), "major").when(oid.startswith("1.3.6.1.4.1.12356.101.2.0"), "minor").otherwise("info")
    ports = interfaces.select("device_id", "if_index", F.col("name").alias("_port"))
    rows = df.withColumn("trap", name).withColumn("kind", kind).withColumn("severity", severity).join(ports, ["device_id", "if_index"], "left")
    label = F.when(link, F.coalesce("_port", F.concat_ws(" ", F.lit("ifIndex"), F.col("if_index").cast("string"))))
    return rows.withColumn("label", label).drop("_port")


def suppress_storms(df: DataFrame, keys: list[str], order: list[str], gap: float = 2.0) -> DataFrame:
    """Rows (t in seconds) of each key at least `gap` seconds after the last one let through, folded in time order."""
    return scan(df, keys, ["t", *order], ["t"], lambda: Gap(gap).step, "_keep boolean").where("_keep").drop("_keep")


class Bucket:
    """Tokens: one second's rate at first, coming back at the rate up to `most`; a flood ends with a line that leaves more than one second's rate."""

    def __init__(self, rate: float, most: float, start: float | None = None) -> None:
        self.start = rate if start is None else start
        self.rate, self.most, self.tokens, self.last, self.flooding = rate, most, self.start, None, False

    def step(self, t: float) -> tuple[bool, bool]:
        if self.last is not None:
            self.tokens = min(self.most, self.tokens + (t - self.last) * self.rate)
        self.last = t
        if self.tokens < 1:
            begins, self.flooding = not self.flooding, True
            return False, begins
        self.tokens -= 1
        self.flooding = self.flooding and self.tokens <= self.start
        return True, False


def limit_rate(df: DataFrame, key: str, rate: float, burst: float | None = None, second: float | None = None) -> DataFrame:
    """A token bucket for each source (t in seconds, n for ties): `passed`, and `flood` on the first refused line of an episode (Bucket).

    second: what the bucket starts with and an episode's end is measured by, the rate of one second if not given (for rates below one a second).
    """
    return scan(df, [key], ["t", "n"], ["t"], lambda: Bucket(rate, burst or 2 * rate, second).step, "passed boolean, flood boolean")


def search(df: DataFrame, start: int, stop: int, device: int | None = None, severity: int | None = None, source: str | None = None, text: str | None = None, limit: int = 500) -> DataFrame:
    """Newest matching lines; time and severity filters reach the scan."""
    rows = df.where(between("recv", start, stop))
    for value, test in ((device, F.col("device_id") == device), (severity, F.col("severity") <= severity), (source, F.col("source") == source)):
        rows = rows if value is None else rows.where(test)
    if text:
        rows = rows.where(F.lower("message").contains(text.lower()) | F.lower("mnemonic").contains(text.lower()))
    return rows.orderBy(F.desc("recv"), F.desc("log_id")).limit(min(limit, 5000))


def histogram(df: DataFrame, start: int, stop: int, buckets: int = 48, newest: int = 100_000) -> DataFrame:
    """Counts of the newest matches in equal buckets of the span, empty buckets too."""
    rows = df.where(between("recv", start, stop)).orderBy(F.desc("recv"), F.desc("log_id")).limit(newest)
    at = F.floor((F.col("recv").cast("timestamp").cast("double") - start) / (stop - start) * buckets)
    counts = rows.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("long").alias("bucket")).agg(F.count("*").alias("lines"))
    return df.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("lines", F.lit(0)).alias("lines"))


def recent_events(df: DataFrame, per_device: int = 20) -> DataFrame:
    """The newest events of each device."""
    w = Window.partitionBy("device_id").orderBy(F.desc("recv"), F.desc("log_id"))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_device)
