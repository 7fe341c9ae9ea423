"""Flow analytics: service ports, top-N summaries, folding, windows and enrichment (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket

#: Names of well-known ports.
PORT_NAMES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp", 68: "dhcp", 69: "tftp", 80: "http", 88: "kerberos",
    110: "pop3", 123: "ntp", 135: "msrpc", 137: "netbios", 138: "netbios", 139: "netbios", 143: "imap", 161: "snmp", 162: "snmp-trap", 179: "bgp",
    389: "ldap", 443: "https", 445: "smb", 465: "smtps", 500: "isakmp", 514: "syslog", 515: "lpd", 520: "rip", 548: "afp", 554: "rtsp", 587: "submission",
    631: "ipp", 636: "ldaps", 853: "dns-tls", 873: "rsync", 989: "ftps", 990: "ftps", 993: "imaps", 995: "pop3s", 1194: "openvpn", 1433: "mssql", 1521: "oracle",
    1723: "pptp", 1812: "radius", 1813: "radius-acct", 2049: "nfs", 2055: "netflow", 3128: "proxy", 3306: "mysql", 3389: "rdp", 3478: "stun", 4500: "ipsec-nat",
    5060: "sip", 5061: "sips", 5222: "xmpp", 5432: "postgres", 5900: "vnc", 5938: "teamviewer", 6343: "sflow", 6379: "redis", 8080: "http-alt", 8443: "https-alt",
    8883: "mqtts", 1883: "mqtt", 9100: "printer", 9200: "elastic", 27017: "mongodb", 51820: "wireguard", 3000: "http-3000", 5000: "http-5000",
}
#: Names of protocols, and sizes of the top lists.
PROTO_NAMES = {1: "icmp", 2: "igmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 51: "ah", 58: "icmpv6", 89: "ospf", 132: "sctp"}
TOPS = {"talkers": (["src"], 100), "targets": (["dst"], 100), "conversations": (["src", "dst", "proto", "port"], 200), "apps": (["proto", "port"], 50)}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def normalise(df: DataFrame) -> DataFrame:
    """Counters scaled by the sampling rate; both are the OUT counters where IN bytes are 0 and OUT bytes aren't; rows without both addresses go."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    egress = (number("in_bytes") == 0) & (number("out_bytes") > 0)
    one = lambda a, b: F.when(egress, number(b)).otherwise(number(a)) * F.greatest(F.coalesce("sampling", F.lit(1)), F.lit(1))
    rows = df.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return rows.withColumns({"bytes": one("in_bytes", "out_bytes").cast("long"), "packets": one("in_packets", "out_packets").cast("long")}).drop("in_bytes", "out_bytes", "in_packets", "out_packets", "sampling")


def service_port(proto: Column, src: Column, dst: Column) -> Column:
    """The port that names a service: a known destination, else a known source, else the lower (0 doesn't count); 0 without ports."""
    known = lambda p: p.isin(*PORT_NAMES)
    return F.when(~proto.isin(6, 17, 132), F.lit(0)).when(known(dst), dst).when(known(src), src).when((src != 0) & (src < dst), src).otherwise(dst).cast("int")


def app_name(proto: Column, port: Column) -> Column:
    named = F.when(proto.isin(6, 17, 132), literal_map(PORT_NAMES)[port.cast("int")])
    kind = F.coalesce(literal_map(PROTO_NAMES)[proto.cast("int")], F.concat(F.lit("ip"), proto.cast("string")))
    return F.coalesce(named, F.when(port == 0, kind), F.concat_ws("/", kind, port.cast("string")))


def with_port(df: DataFrame) -> DataFrame:
    return df.withColumn("port", service_port(F.col("proto"), F.col("src_port"), F.col("dst_port")))


def totals(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Bytes, packets and flows of each exporter and bucket."""
    return df.groupBy("exporter", bucket(F.col("ts"), seconds).alias("t")).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("flows"))


def top(df: DataFrame, group: list[str], keys: list[str], n: int) -> DataFrame:
    """The n keys with the most bytes in each group; ties by key. Sums are partial before the shuffle, ranks cut before theirs."""
    sums = df.groupBy(*group, *keys).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flows").alias("flows"))
    w = Window.partitionBy(*group).orderBy(F.desc("bytes"), *keys)
    return sums.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def summary(df: DataFrame, which: str, seconds: int = 60, n: int | None = None) -> DataFrame:
    """A top list (talkers, targets, conversations, apps) of each exporter and bucket."""
    keys, most = TOPS[which]
    rows = with_port(df).withColumn("t", bucket(F.col("ts"), seconds)).withColumn("flows", F.lit(1))
    return top(rows, ["exporter", "t"], keys, n or most)


def interface_totals(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Bytes into and out of each interface: the in side always, the out side unless it equals the in side (except index 0)."""
    side = lambda c, i, o: F.struct(F.col(c).cast("int").alias("if_index"), F.lit(i).alias("is_in"), F.lit(o).alias("is_out"))
    out = F.when((F.col("out_if") != F.col("in_if")) | (F.col("out_if") == 0), F.array(side("in_if", 1, 0), side("out_if", 0, 1))).otherwise(F.array(side("in_if", 1, 0)))
    rows = df.withColumn("x", F.explode(out)).select("exporter", bucket(F.col("ts"), seconds).alias("t"), "x.*", "bytes")
    return rows.groupBy("exporter", "t", "if_index").agg(F.sum(F.col("bytes") * F.col("is_in")).alias("in_bytes"), F.sum(F.col("bytes") * F.col("is_out")).alias("out_bytes"))


def key_overflow(df: DataFrame, limit: int = 50_000, seconds: int = 60) -> DataFrame:
    """Whether an exporter's bucket has more distinct conversations than a bounded table would hold."""
    keys = with_port(df).groupBy("exporter", bucket(F.col("ts"), seconds).alias("t")).agg(F.countDistinct("src", "dst", "proto", "port").alias("keys"))
    return keys.withColumn("overflow", F.col("keys") > limit)


def fold(lists: DataFrame, which: str, fine: str = "t", seconds: int = 300, n: int | None = None) -> DataFrame:
    """Minute top lists added up by key in wider buckets and cut again."""
    keys, most = TOPS[which]
    rows = lists.drop("place").withColumn("t", (F.floor(F.col(fine) / seconds) * seconds).cast("long"))
    return top(rows, ["exporter", "t"], keys, n or most)


def window_totals(minutes: DataFrame, fives: DataFrame, now: int, span: int) -> DataFrame:
    """Totals of each exporter in (now - span, now]: up to an hour from minutes and, before the first of these, 5-minute rows; longer spans from 5-minute rows only. covered: seconds that rows stand for, span at most."""
    start = now - span
    five = fives.where((F.col("t") > start) & (F.col("t") <= now)).withColumn("span", F.lit(300))
    if span <= 3600:
        minute = minutes.where((F.col("t") > start) & (F.col("t") <= now)).withColumn("span", F.lit(60))
        first = minute.groupBy("exporter").agg(F.min("t").alias("first"))
        five = five.join(first, "exporter", "left").where(F.col("first").isNull() | (F.col("t") + 300 <= F.col("first"))).drop("first")
        five = five.unionByName(minute)
    return five.groupBy("exporter").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flows").alias("flows"), F.least(F.sum("span"), F.lit(span)).cast("long").alias("covered"))


def throughput(df: DataFrame) -> DataFrame:
    """Totals of all exporters at each time with the widest span."""
    return df.groupBy("t").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.max("span").alias("span"))


def fill_idle(df: DataFrame, seconds: int, start: int, stop: int) -> DataFrame:
    """Zero rows for buckets in [start, stop] in which a known exporter sent nothing, from its first bucket on."""
    first = df.groupBy("exporter").agg(F.min("t").alias("first"))
    lo = F.greatest("first", F.lit(start))
    days = first.where(lo <= stop).select("exporter", F.explode(F.sequence(lo, F.lit(stop), F.lit(seconds))).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return days.join(df, ["exporter", "t"], "left").select("exporter", "t", zero("bytes"), zero("packets"), zero("flows"))


def exporters(df: DataFrame, now: int, span: int) -> DataFrame:
    recent = F.when(F.col("t") > now - span, F.col("bytes")).otherwise(0)
    return df.groupBy("exporter").agg(F.max("t").alias("last_seen"), F.sum("flows").alias("records"), F.sum(recent).alias("recent_bytes")).orderBy("exporter")


def with_names(df: DataFrame, devices: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Device and interface names by left joins on what identifies them; Spark broadcasts these sides while they are small."""
    named = df.join(devices.select(F.col("device_id").alias("exporter"), F.col("name").alias("device")), "exporter", "left")
    ports = interfaces.select(F.col("device_id").alias("exporter"), "if_index", F.col("name").alias("interface"))
    return named.join(ports, ["exporter", "if_index"], "left")


def unknown_exporters(df: DataFrame, devices: DataFrame) -> DataFrame:
    return df.join(devices.select(F.col("device_id").alias("exporter")), "exporter", "left_anti").groupBy("exporter").agg(F.count("*").alias("records"))


def traffic_share(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n keys with the most bytes and their percentage of all bytes."""
    sums = df.groupBy(key).agg(F.sum("bytes").alias("bytes"))
    whole = sums.agg(F.greatest(F.sum("bytes"), F.lit(1)).alias("whole"))
    best = sums.orderBy(F.desc("bytes"), key).limit(n)
    return best.join(F.broadcast(whole), F.lit(True)).select(key, "bytes", F.round(F.col("bytes") / F.col("whole") * 100, 6).alias("share_pct"))
