"""Operators on literal rows whose results are known."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.functions.columns import canonical_mac, readable_bytes, readable_duration, short_host, short_port, top_bits
from pulsegrid.operators import alerts, endpoints, flow, inventory, logs, metrics, reports, snapshots, state, topology
from pulsegrid.sources import files

T0 = datetime(2024, 1, 1, 12, 0, 0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rollup_of_a_day(spark):
    df = spark.range(1440).select(F.lit("a").alias("series"), (F.lit(T0.replace(hour=0)).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 300).cast("double").alias("v"))
    made = metrics.rollup(df, ["series"]).orderBy("t").collect()
    assert len(made) == 288 and tuple(made[0])[2:] == (2.0, 0.0, 4.0)


def test_append_rules(spark):
    df = spark.createDataFrame([("a", 7200, 1, 1.0), ("a", 7200, 2, 2.0), ("b", 3000, 3, 9.0), ("b", 7300, 4, float("nan")), ("b", 7201, 5, 5.0), ("a", 7199, 6, 7.0)], "s string, t long, arrival long, v double")
    assert sorted(rows(metrics.accept_samples(df, ["s"]))) == [("a", 7200, 2.0), ("b", 7201, 5.0)]
    assert rows(metrics.accept_samples(df.limit(0), ["s"])) == []


def test_counter_rates(spark):
    df = spark.createDataFrame([(1, 1, T0, 4294967290, 100, 0), (1, 1, T0 + timedelta(seconds=10), 4, 50, 20), (1, 1, T0 + timedelta(seconds=10, microseconds=1), 5, 60, 20)], "device_id int, if_index int, ts timestamp, in_oct32 long, in_oct64 long, in_err long")
    assert [r[3:] for r in rows(metrics.counters_to_rates(df).orderBy("ts"))] == [(None, None, None), (8.0, 0.0, 2.0), (None, None, None)]


def test_quantiser_and_units(spark):
    one = spark.createDataFrame([(1.0, 0.0, -3.14159)], "a double, b double, c double").select(top_bits(F.col("a")), top_bits(F.col("b")), top_bits(F.col("c"))).first()
    assert one[0] == 1.0 and one[1] == 0.0 and abs(one[2] + 3.14159) < 0.001
    made = spark.range(1).select(readable_duration(F.lit(172800)), readable_duration(F.lit(4020)), readable_duration(F.lit(30)), readable_bytes(F.lit(1536))).first()
    assert tuple(made) == ("2d 0h", "1h 07m", "1m", "1.5 KB")


def test_echo_statistics(spark):
    polls = [("a", 1, True, 1.0), ("a", 2, True, 3.0), ("a", 3, False, None), ("a", 4, True, 2.0), ("b", 1, False, None)]
    made = metrics.echo_statistics(spark.createDataFrame(polls, "id string, n int, reachable boolean, rtt_ms double"), ["id"], ["n"]).orderBy("id").collect()
    assert (made[0].loss_pct, made[0].avg_ms, made[0].jitter_ms) == (25.0, 2.0, 1.5) and made[1].loss_pct == 100.0 and made[1].avg_ms is None


def test_kept_series(spark):
    df = spark.createDataFrame([("p", 0, True, 1.0, 0.0, 3.0), ("q", 0, False, 1.0, 0.0, 0.0)], "port string, t int, important boolean, bps double, err double, drop double")
    df = df.withColumns({f"{d}_{n}": F.col(n) if d == "in" else F.lit(0.0) for d in ("in", "out") for n in ("bps", "err", "drop")}).withColumns({"in_pps": F.lit(5.0), "out_pps": F.lit(6.0)})
    made = {(r.port, r.series): r.v for r in metrics.kept_series(df, ["port"]).collect()}
    assert made == {("p", "if_in_bps"): 1.0, ("p", "if_out_bps"): 0.0, ("p", "if_in_drop"): 3.0, ("p", "if_out_drop"): 0.0, ("p", "if_in_pps"): 5.0, ("p", "if_out_pps"): 6.0, ("q", "if_in_bps"): 1.0, ("q", "if_out_bps"): 0.0}


def test_fold_carries_one_state_over_batches(spark):
    """A key with far more rows than a batch, and null keys, folded in order."""
    from pulsegrid.functions.folds import scan

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))).alias("k"), "id").repartition(5)

        def count():
            n = [0]

            def step(_):
                n[0] += 1
                return n[0]

            return step

        made = scan(df, ["k"], ["id"], ["id"], count, "n int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    place = {}
    for r in sorted(made, key=lambda r: r.id):
        place[r.k] = place.get(r.k, 0) + 1
        assert r.n == place[r.k]
    assert len(made) == 2000


def test_time_tests_reach_the_scan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("event_id").alias("log_id"), F.col("ts").alias("recv"), F.col("ts").alias("opened_at"), F.col("ts").alias("resolved_at"), F.col("event_type").alias("rule"), F.col("event_type").alias("severity"), F.lit("config_changed").alias("kind"), F.col("event_id").alias("id"))
    for df in (logs.search(events, 1704499200, 1705363200), logs.histogram(events, 1704499200, 1705363200), files.retained(events, "recv", "raw", 1706572800), reports.alert_causes(events, 1704672000, 1705881600), reports.changes(events.withColumnRenamed("recv", "ts"), 1704672000, 1705881600)):
        plan = df._jdf.queryExecution().toString()
        assert any("PushedFilters: [" in line and "GreaterThanOrEqual(ts" in line for line in plan.splitlines())


def test_flow_ports_and_tops(spark):
    df = spark.createDataFrame([(6, 443, 51234), (17, 40000, 40001), (1, 5, 6), (47, 0, 0)], "proto int, src_port int, dst_port int")
    made = flow.with_port(df).select("port", flow.app_name(F.col("proto"), F.col("port")))
    assert rows(made) == [(443, "https"), (40000, "udp/40000"), (0, "icmp"), (0, "gre")]
    records = spark.createDataFrame([(9, f"10.1.1.{i}", "1.1.1.1", 50000, 443, 6, 1, 2, b, 1, T0) for i, b in ((1, 5000), (2, 3000), (3, 7000), (1, 100))], "exporter int, src string, dst string, src_port int, dst_port int, proto int, in_if int, out_if int, bytes long, packets long, ts timestamp")
    assert [(r.src, r.bytes) for r in flow.summary(records, "talkers").orderBy("place").collect()] == [("10.1.1.3", 7000), ("10.1.1.1", 5100), ("10.1.1.2", 3000)]
    assert sorted(r[2:] for r in rows(flow.interface_totals(records))) == [(1, 15100, 0), (2, 0, 15100)]


def test_log_lines(spark):
    lines = [("<189>12: Jan  1 12:00:00 UTC: %LINK-3-UPDOWN: Interface Gi1/0/1, changed state to down",), ("<133>%SYS-5-CONFIG_I: Configured from console by bob",), ('<13>1 2024-01-01T11:59:00Z fw1 app - - - logid="1" type="event" subtype="ha" level="critical" logdesc="HA change"',), ("garbage",)]
    df = spark.createDataFrame(lines, "raw string").withColumn("recv", F.lit(T0).cast("timestamp_ntz"))
    made = logs.parse_lines(df).select("severity", "mnemonic", "facility", "ts").collect()
    assert [r[:3] for r in map(tuple, made)] == [(3, "LINK-3-UPDOWN", 23), (5, "SYS-5-CONFIG_I", 16), (2, "FGT-event-ha-HA_CHANGE", 1), (6, "", 1)]
    assert made[2].ts == datetime(2024, 1, 1, 11, 59) and made[3].ts == T0
    events = logs.classify(logs.parse_lines(df).withColumn("device_id", F.lit(1))).select("kind", "subject").collect()
    assert [tuple(e) for e in events] == [("link_down", "Gi1/0/1"), ("config_changed", "bob"), ("ha_state_change", None)]


def test_storms_and_rate_limit(spark):
    df = spark.createDataFrame([("k", t) for t in (0.0, 1.0, 1.9, 2.0, 3.0, 4.1)], "k string, t double")
    assert sorted(r.t for r in logs.suppress_storms(df, ["k"], []).collect()) == [0.0, 2.0, 4.1]
    burst = spark.createDataFrame([("h", i, 0.0) for i in range(5)], "host string, n int, t double")
    made = logs.limit_rate(burst, "host", 1).orderBy("n").collect()
    assert [r.passed for r in made] == [True, False, False, False, False] and [r.flood for r in made] == [False, True, False, False, False]


def test_status_machine(spark):
    polls = [(1, i, ok) for i, ok in enumerate([True, False, False, False, True, True])]
    df = spark.createDataFrame(polls, "device_id int, n int, reachable boolean").withColumns({"degraded": F.lit(False), "maintenance": F.lit(False), "upstream_down": F.lit(False)})
    run = lambda df: [r.status for r in state.device_status(df, "device_id", ["n"]).orderBy("n").collect()]
    assert run(df) == ["up", "up", "up", "down", "down", "up"]
    assert run(df.withColumn("upstream_down", F.lit(True))) == ["up", "up", "up", "unreachable", "unreachable", "up"]
    silent = df.withColumns({"reachable": F.col("n") == 5, "maintenance": F.col("n") == 2, "degraded": F.lit(True)})
    assert run(silent) == ["unknown", "unknown", "maintenance", "down", "down", "down"]
    assert run(silent.withColumn("maintenance", F.col("n") == 0)) == ["maintenance", "up", "down", "down", "down", "down"]  # an unconfirmed silence after maintenance


def test_threshold_holds_between_levels():
    t = state.Threshold(10, 5, 2)
    assert [t.step(v) for v in (11, 7, 12, 7, 5, 11)] == [False, False, True, True, False, False]


def test_suppressed_chain(spark):
    status = spark.createDataFrame([(1, "down"), (2, "down"), (3, "down"), (4, "up")], "device_id long, status string")
    parents = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "device_id long, parent long")
    assert sorted(rows(state.suppressed(status, parents))) == [(1, "down", None), (2, "unreachable", 1), (3, "unreachable", 1), (4, "up", None)]


def test_suppressed_long_chain(spark):
    status = spark.createDataFrame([(i, "down") for i in range(1, 81)], "device_id long, status string")
    made = rows(state.suppressed(status, spark.createDataFrame([(i, i - 1) for i in range(2, 81)], "device_id long, parent long")))
    assert sorted(made) == [(1, "down", None)] + [(i, "unreachable", 1) for i in range(2, 81)]


def test_tree_of_seventy_hops(spark):
    from pulsegrid.sources.storage import with_checkpoints

    with_checkpoints(spark)
    n = 71
    devices = spark.createDataFrame([(i, 1, "router" if i == 1 else "access") for i in range(1, n + 1)], "device_id long, site_id int, role string").coalesce(1)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, n)], "a_device long, b_device long").coalesce(1)
    assert sorted(rows(topology.parents(devices, links))) == [(i, i - 1 if i > 1 else None, i - 1) for i in range(1, n + 1)]
    tree = spark.createDataFrame([(i, i - 1 if i > 1 else None, i - 1) for i in range(1, n + 1)], "device_id long, parent long, hop int").coalesce(1)
    assert sorted(rows(topology.impact(tree))) == [(i, n - i) for i in range(1, n + 1)]


def test_alert_life(spark):
    acts = [("k", 0.0, 1, "raise", 2, None), ("k", 10.0, 2, "raise", 4, None), ("k", 15.0, 3, "notified", 0, None), ("k", 20.0, 4, "resolve", 0, None), ("k", 100.0, 5, "raise", 1, None), ("k", 200.0, 6, "resolve", 0, None), ("k", 9000.0, 7, "raise", 3, None), ("k", 9001.0, 8, "raise", 2, "root")]
    made = alerts.upsert_alerts(spark.createDataFrame(acts, "dedup_key string, t double, n int, action string, severity int, root_cause string").withColumn("source", F.lit("snmp"))).orderBy("n").collect()
    assert [(r.opened, r.resolved, r.occurrences, r.severity, r.reopened, r.root_cause, r.notified) for r in made] == [(0.0, 200.0, 3, 4, 1, None, False), (9000.0, None, 2, 2, 0, "root", False)]
    assert ", ".join(made[0].evidence) == "snmp 00:00:00, snmp 00:00:10, resolved: snmp 00:00:20, snmp 00:01:40 (re-opened), resolved: snmp 00:03:20"


def test_links_and_parents(spark):
    obs = spark.createDataFrame([(1, "a", 2, "b", "lldp"), (2, "b", 1, "a", "cdp"), (2, "c", 3, "d", "lldp"), (3, "x", 3, "y", "lldp")], "device_id long, local_if string, remote_id long, remote_if string, source string")
    links = topology.synthesise_links(obs)
    assert sorted((r.a_device, r.b_device, r.sources, r.confidence) for r in links.collect()) == [(1, 2, "cdp,lldp", 1.0), (2, 3, "lldp", 0.8)]
    devices = spark.createDataFrame([(1, 1, "router"), (2, 1, "core"), (3, 1, "access")], "device_id long, site_id int, role string")
    tree = topology.parents(devices, links)
    assert sorted(rows(tree)) == [(1, 2, 1), (2, None, 0), (3, 2, 1)]
    assert sorted(rows(topology.impact(tree))) == [(1, 0), (2, 2), (3, 0)]


def test_endpoint_placement(spark):
    trunk = [(1, 1, f"0000000000{i:02x}", T0) for i in range(0, 102, 2)]
    fdb = spark.createDataFrame([*trunk, (2, 7, "000000000000", T0)], "device_id int, if_index int, mac string, ts timestamp")
    none = fdb.select("device_id", "if_index").limit(0)
    made = {r.mac: (r.device_id, r.if_index) for r in endpoints.place(fdb, none).collect()}
    assert made["000000000000"] == (2, 7) and made["000000000002"] == (1, 1)


def test_names(spark):
    made = spark.range(1).select(canonical_mac(F.lit("00-1A.2b:3C4d5E")), canonical_mac(F.lit("001a2b3c4d5")), short_port(F.lit("GigabitEthernet1/0/1")), short_port(F.lit(" TenGigE0/1")), short_host(F.lit("SW1.example.net"))).first()
    assert tuple(made) == ("00:1a:2b:3c:4d:5e", "", "gi1/0/1", "te0/1", "sw1")


def test_configuration_diff(spark):
    ops = snapshots.line_ops("a\nb\nc", "a\nc\nd")
    assert ops == [("=", "a"), ("-", "b"), ("=", "c"), ("+", "d")] and snapshots.hunks(ops, 0) == ["-b", "+d"]
    made = snapshots.diffs(spark.createDataFrame([(1, "a\nb", "a\nb\nc"), (2, None, "x")], "id int, old string, new string")).orderBy("id").collect()
    assert (made[0].added, made[0].removed) == (1, 0) and made[1].added == 1


def test_http_status(spark):
    made = spark.range(1).select(snapshots.status_matches(F.lit(301), F.lit("200-299,301")), snapshots.status_matches(F.lit(404), F.lit("200-299, 301")), snapshots.status_matches(F.lit(200), F.lit("x"))).first()
    assert tuple(made) == (True, False, False)


def test_availability(spark):
    devices = spark.createDataFrame([(1, 0), (2, 0)], "device_id int, created long")
    outage = spark.createDataFrame([(1, 36000, 43200)], "device_id int, opened long, resolved long")
    assert [r.availability for r in reports.availability(devices, outage, 0, 172800).orderBy("device_id").collect()] == [95.8333, 100.0]


def test_evidence(spark):
    df = spark.createDataFrame([('{"b": "ok", "API_Token": 1, "a": {"b": {"c": {"d": 1}}}, "t": "act as root"}',), ("no json",), (None,)], "e string")
    assert rows(reports.sanitise_json(df, "e"))[0][0] == '{"a":{"b":{"c":"[omitted: nested too deep]"}},"b":"ok","t":"[omitted: instruction-like text]"}'
    flat = spark.range(1).select(reports.sanitise_flat(F.create_map(F.lit("password"), F.lit("x"), F.lit("note"), F.lit("fine")))).first()[0]
    assert flat == {"note": "fine"}


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.0/30",), ("10.0.0.9-10.0.0.11",), ("10.1.1.1",), ("10.0.0.4/31",)], "spec string")
    made = sorted(rows(inventory.expand_addresses(df)))
    assert [r[1] for r in made] == ["10.0.0.1", "10.0.0.2", "10.0.0.4", "10.0.0.5", "10.0.0.10", "10.0.0.11", "10.0.0.9", "10.1.1.1"]


def test_diff_is_minimal_at_every_size():
    import random

    rng = random.Random(4)

    def table(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    for n, base in [(0, 3), (1, 3), (7, 3), (40, 6), (120, 20)] * 6:
        x, y = ([str(rng.randrange(base)) for _ in range(rng.randrange(n + 1))] for _ in range(2))
        ops = snapshots.line_ops("\n".join(x), "\n".join(y))
        x, y = x or [""], y or [""]
        assert [s for o, s in ops if o != "+"] == x and [s for o, s in ops if o != "-"] == y
        assert sum(o == "=" for o, _ in ops) == table(x, y)
    x = [str(rng.randrange(900)) for _ in range(5000)]
    y = [str(rng.randrange(900)) for _ in range(5000)]
    ops = snapshots.line_ops("\n".join(x), "\n".join(y))
    assert [s for o, s in ops if o != "+"] == x and [s for o, s in ops if o != "-"] == y
    assert sum(o == "=" for o, _ in ops) == int(snapshots.common_lengths(x, y)[-1])  # not halved


def test_unreached_devices_and_external_nodes(spark):
    devices = spark.createDataFrame([(1, 1, "router", "r", "up"), (2, 1, "access", "s", "down"), (3, 1, "access", "t", "up"), (4, 2, "core", "u", "up")], "device_id long, site_id int, role string, name string, status string")
    links = spark.createDataFrame([(1, "a", 2, "b", 1.0, False, False, None), (4, "c", 1, "d", 0.3, True, False, None), (1, "e", 9, "f", 0.6, False, True, "ISP")], "a_device long, a_if string, b_device long, b_if string, confidence double, manual boolean, external boolean, external_name string")
    tree = sorted(rows(topology.parents(devices, links.where("confidence = 1"))))
    assert tree == [(1, None, 0), (2, 1, 1), (3, None, None), (4, None, None)]
    alerts_ = spark.createDataFrame([(2, "open"), (2, "resolved")], "device_id long, state string")
    shown, nodes = topology.view(links, devices, alerts_, 1)
    assert sorted((r.a_device, r.b_device, r.b_alerts) for r in shown.collect()) == [(1, 2, 1), (1, 9, 0), (4, 1, 0)]
    assert sorted(r.node for r in nodes.collect()) == ["1", "2", "3", "ext:isp"]


def test_moves_within_a_day_and_search(spark):
    now = spark.createDataFrame([("aa", 1, 7, T0), ("bb", 1, 8, T0)], "mac string, device_id int, if_index int, ts timestamp_ntz")
    old = spark.createDataFrame([("aa", 2, 7, T0 - timedelta(hours=23)), ("bb", 2, 8, T0 - timedelta(hours=24))], "mac string, device_id int, if_index int, ts timestamp_ntz")
    assert [r.mac for r in endpoints.moves(now, old, now).collect()] == ["aa"]
    known = spark.createDataFrame([("001a2b3c4d5e", "10.0.0.1,10.0.0.2", "Acme", 1, 9, 3, "Gi0/3", 5), ("ffeeddccbbaa", None, "", None, 1, None, None, 6)], "mac string, ips string, vendor string, device_id int, arp_device int, if_index int, if_name string, seen int")
    found = lambda *a: [r.mac[:2] for r in endpoints.search(known, *a).collect()]
    assert found("10.0.0.2") == found("ACME") == found("gi0/3") == found("2b:3c") == found("00:1a:2b:3c:4d:5e") == found("", 1, 3) == ["00"]
    assert found("") == found("", 1) == ["ff", "00"] and found("", 9) == ["00"] and found("zz") == []


def test_stale_by_timer(spark, tmp_path):
    from pulsegrid.streaming import jobs

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "device_id long, ts timestamp"
    for polls in ([(1, at(0)), (2, at(0))], [(2, at(400))], [(2, at(800))]):
        spark.createDataFrame(polls, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.intake(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    jobs.run(jobs.stale(stream, 60), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1, 1704067200, "unknown")]
    made = jobs.messages(spark.createDataFrame([('{"device_id": 4}',), ("nonsense",)], "value string"), spark.createDataFrame([], "device_id long").schema).collect()
    assert [r.device_id for r in made if r.device_id] == [4]


def test_an_address_is_no_part_of_a_mac(spark):
    known = spark.createDataFrame([("dd0000001021", "10.9.0.1", "", 1, None, None, None, 4), ("ee0000000000", "10.2.1.7", "", 1, None, None, None, 3)], "mac string, ips string, vendor string, device_id int, arp_device int, if_index int, if_name string, seen int")
    found = lambda text: [r.mac[:2] for r in endpoints.search(known, text).collect()]
    assert found("10.2.1.") == found("10.2.1.7") == ["ee"] and found("10.21") == []
    assert found("1021") == found("00:10:21") == found("0000.1021") == ["dd"]


def busiest_task(df):
    """The most rows that one task of the last stage holds, with four tasks, and all rows."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return max(n), sum(n)


def test_alerts_without_a_root_dont_meet_in_one_task(spark):
    a = spark.range(0, 4000, 1, 4).selectExpr("id", "case when id % 50 = 3 then id - 1 end as root_cause", "concat('t', id) as title", "id as device_id", "id as site_id", "'open' as state", "timestamp_ntz'2024-01-01' as opened_at", "timestamp_ntz'2024-01-01' as resolved_at", "array('snmp') as evidence", "'d' as detail")
    devices, sites = spark.range(4000).selectExpr("id as device_id", "concat('d', id) as name"), spark.range(4000).selectExpr("id as site_id", "concat('s', id) as name")
    facts = reports.alert_facts(a, devices, sites, 1704153600)
    assert facts.count() == 4000 and facts.where("root_title is not null").count() == facts.where("root_title = concat('t', id - 1)").count() == 80
    roots = reports.left_join(a, "root_cause", a.select(F.col("id").alias("root_cause"), F.col("title").alias("root_title")))
    most, rows_ = busiest_task(roots)
    assert rows_ == 4000 and most < 2000


def test_places_are_counted_without_one_task(spark):
    """An alert without an opening stands first in its severity; equal times go by id; days and minutes follow one another."""
    a = spark.range(0, 3000, 1, 4).selectExpr("id", "case id % 3 when 0 then 'critical' when 1 then 'minor' else 'major' end as severity", "'open' as state", "false as notified", "case when id % 100 <> 7 then timestamp_seconds(1704067200 + id * 7919 % 400 * 400) end as opened_at", "timestamp_seconds(0) as updated_at")
    made = alerts.to_notify(a, 1705000000)
    levels = {"critical": 0, "major": 1, "minor": 2}
    want = sorted(a.collect(), key=lambda r: (levels[r.severity], r.opened_at is not None, r.opened_at or T0, r.id))
    assert [r.id for r in sorted(made.collect(), key=lambda r: r.place)] == [r.id for r in want] and sorted(r.place for r in made.collect()) == list(range(1, 3001))
    most, rows_ = busiest_task(made)
    assert rows_ == 3000 and most < 1500
