"""Column functions: times, rates, names, addresses and readable units."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, of a timestamp with or without zone (the session runs in UTC)."""
    return F.floor(ts.cast("timestamp").cast("double")).cast("long")


def civil_time(seconds: Column, zone: Column) -> Column:
    """The wall clock of a zone at a moment, as a timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), zone, F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def between(ts: str, start: int, stop: int) -> Column:
    """start <= whole seconds of ts <= stop, as a test on the column itself, which reaches the scan."""
    lo = datetime(1970, 1, 1) + timedelta(seconds=start)
    return (F.col(ts) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(ts) < F.lit(lo + timedelta(seconds=stop - start + 1)).cast("timestamp_ntz"))


def since(ts: str, start: int) -> Column:
    """start <= ts, as a test that reaches the scan."""
    return F.col(ts) >= F.lit(datetime(1970, 1, 1) + timedelta(seconds=start)).cast("timestamp_ntz")


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the time bucket, in seconds since 1970."""
    return (F.floor(epoch(ts) / seconds) * seconds).cast("long")


def top_bits(v: Column) -> Column:
    """A value as float32 with the low 11 of its 23 mantissa bits cleared; zero, null, NaN and infinities stay."""
    x = F.abs(v.cast("float").cast("double"))
    e = F.floor(F.log2(x))
    e = e - F.when(F.pow(F.lit(2.0), e) > x, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), e + 1) <= x, 1).otherwise(0)
    step = F.pow(F.lit(2.0), e - 12)
    plain = (x > 0) & (x < float("inf"))
    return F.when(plain, F.signum(v) * F.floor(x / step) * step).otherwise(v.cast("float").cast("double"))


#: Long vendor prefixes of port names and their short forms, the first match counts.
PORT_PREFIXES = [
    ("HundredGigE", "Hu"), ("HundredGigabitEthernet", "Hu"), ("FortyGigabitEthernet", "Fo"), ("TwentyFiveGigE", "Twe"),
    ("TenGigabitEthernet", "Te"), ("TenGigE", "Te"), ("GigabitEthernet", "Gi"), ("FastEthernet", "Fa"), ("Port-channel", "Po"),
    ("Bundle-Ether", "BE"), ("Ethernet", "Eth"), ("management", "mgmt"), ("Management", "mgmt"),
]


def short_port(name: Column) -> Column:
    """Port name with its vendor prefix cut short, in lower case."""
    name = F.trim(name)
    out = None
    for long, short in PORT_PREFIXES:
        hit, made = name.startswith(long), F.concat(F.lit(short), F.substring(name, len(long) + 1, 1000))
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return F.lower(out.otherwise(name))


def short_host(name: Column) -> Column:
    """Host name in lower case up to its first dot; a leading dot stays."""
    name = F.lower(F.trim(name))
    return F.when(F.locate(".", name) > 1, F.substring_index(name, ".", 1)).otherwise(name)


def is_mac(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^([0-9a-f]{2}[:\-]){5}[0-9a-f]{2}$|^[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}$")


def canonical_mac(text: Column) -> Column:
    """aa:bb:cc:dd:ee:ff, or empty unless there are twelve hex digits between separators."""
    digits = F.lower(F.regexp_replace(F.trim(text), r"[:.\-]", ""))
    return F.when(digits.rlike("^[0-9a-f]{12}$"), F.regexp_replace(digits, r"(..)(?!$)", "$1:")).otherwise("")


def is_multicast(mac: Column) -> Column:
    """Odd second hex digit of a canonical address."""
    return F.substring(mac, 2, 1).isin(*"13579bdf")


#: Names of log severities 0 to 7.
SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]


def severity_name(n: Column) -> Column:
    return F.when(n.between(0, 7), F.element_at(F.array(*map(F.lit, SEVERITIES)), (n + 1).cast("int"))).otherwise(n.cast("string"))


def rank(severity: Column) -> Column:
    """critical 4, major 3, minor 2, info 1, else 0."""
    return F.when(severity == "critical", 4).when(severity == "major", 3).when(severity == "minor", 2).when(severity == "info", 1).otherwise(0)


def readable_duration(seconds: Column) -> Column:
    """Rounded to minutes: 3d 4h from 48 hours, 5h 07m from one hour, else 12m."""
    m = F.floor(seconds / 60 + 0.5).cast("long")
    h = F.floor(m / 60).cast("long")
    days = F.format_string("%dd %dh", F.floor(h / 24).cast("long"), h % 24)
    return F.when(h >= 48, days).when(h > 0, F.format_string("%dh %02dm", h, m % 60)).otherwise(F.format_string("%dm", F.greatest(m, F.lit(0))))


def readable_speed(mbps: Column) -> Column:
    return F.when(mbps >= 1000, F.format_string("%dG", F.floor(mbps / 1000).cast("long"))).otherwise(F.format_string("%dM", mbps.cast("long")))


def readable_bytes(v: Column) -> Column:
    out = None
    for n, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        made = F.format_string(f"%.1f {unit}", v / F.lit(float(1024**n)))
        test = v < 1024 ** (n + 1)
        out = F.when(test, made) if out is None else (out.when(test, made) if n < 4 else out.otherwise(made))
    return out
