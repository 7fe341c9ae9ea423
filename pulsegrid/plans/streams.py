"""Query S9 and the streaming forms of M3, P2, L7: run over the tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch
from ..operators.reports import finding_changes
from ..sources.files import deliver
from ..sources.storage import fresh_path
from ..streaming import jobs as J
from .alerts import ACTIONS, BOTH, FAMILIES
from .metrics import ROLLUP
from .registry import ORACLES, Data, query
from .state import STATUS, polls


def _slices(d: Data, rows: DataFrame, number: str, form: str = "parquet", slices: int = 3, key: str | None = None, files: int = 4) -> DataFrame:
    """Rows as a stream of several micro-batches: they land in a folder slice by slice, in order of a number, a slice's rows in `files` files; with a key, all of a key's rows of a slice in one."""
    path = fresh_path(d.spark, "landing")
    last = rows.agg(F.max(number)).first()[0] or 0
    for k in range(slices):
        own = rows.where(F.floor(F.col(number) * slices / (last + 1)) == k)
        own.repartition(files, *([key] if key else [])).write.mode("append").format(form).save(path)
    return J.intake(d.spark, path, rows.schema, files, form)


def _events(d: Data, slices: int = 3) -> DataFrame:
    """The events as such a stream."""
    return _slices(d, d("events"), "event_id", slices=slices, key="user_id")


def _through(d: Data, stream: DataFrame, mode: str = "append") -> str:
    path = fresh_path(d.spark, "stream")
    J.run(stream, f"{path}/checkpoint", f"{path}/rows", mode)
    return f"{path}/rows"


@query("S9_stream_intake", "select event_id, user_id as device_id, ts, value as rtt_ms, event_type <> 'error' as reachable from events")
def s9(d: Data):
    rows = _events(d).select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("rtt_ms"), (F.col("event_type") != "error").alias("reachable"))
    return d.spark.read.parquet(_through(d, rows))


@query("M3_stream_rollup", ROLLUP.format(""))
def m3_stream(d: Data):
    rows = _events(d).select(F.col("event_type").alias("metric"), F.col("user_id").alias("device_id"), "ts", F.col("value").alias("v"))
    return J.latest(d.spark, _through(d, J.rollup(rows, ["metric", "device_id"]), "update"), ["metric", "device_id", "t"])


@query("P2_stream_thresholds", ORACLES.get("P2_thresholds"))
def p2_stream(d: Data):
    rows = _events(d).select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("device_id"), "ts", (F.col("value") % 100).alias("v"))
    return d.spark.read.parquet(_through(d, J.thresholds(rows, 30, 10, 2)))


@query("L7_stream_suppression", f"select event_id, user_id::VARCHAR || '|' || event_type as key from ({ORACLES['L7_storm_suppression']})")
def l7_stream(d: Data):
    rows = _events(d).select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return d.spark.read.parquet(_through(d, J.suppress(rows, 43200)))


@query("S9_json_intake", "select event_id, user_id as device_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, event_type as kind from events")
def s9_json(d: Data):
    rows = d("events").select("event_id", F.col("user_id").alias("device_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("event_type").alias("kind"))
    return d.spark.read.parquet(_through(d, _slices(d, rows, "event_id", "json")))


@query("P4_stream_status", STATUS + " select device_id, sample_id, status from f")
def p4_stream(d: Data):
    return d.spark.read.parquet(_through(d, J.statuses(_slices(d, polls(d), "sample_id", key="device_id"), 2)))


@query("P12_stream_alerts", ORACLES.get("P12_upserted_alerts"))
def p12_stream(d: Data):
    rows = d.sql(ACTIONS)
    return J.latest(d.spark, _through(d, J.alerts(_slices(d, rows, "n", key="dedup_key"), 30000), "update"), ["dedup_key", "n"]).withColumn("evidence", F.array_join("evidence", ", "))


@query("P17_stream_ends", ORACLES.get("P17_alert_ends"))
def p17_stream(d: Data):
    return d.spark.read.parquet(_through(d, J.ended(_slices(d, d.sql(FAMILIES), "n", slices=6), 90000)))


@query("P23_stream_actions", ORACLES.get("P23_acted_alerts"))
def p23_stream(d: Data):
    rows = d.sql(BOTH)
    hand = F.col("action").isin("ack", "manual")
    ends = rows.agg(F.max_by("dedup_key", "t").alias("dedup_key"), F.max("n").alias("n"), F.max("t").alias("t"))  # both streams end at the same time
    mark = ends.select("dedup_key", "n", "t", F.lit("none").alias("action"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("dedup_key", "n", "t", "action")])
    made = J.acted_alerts(_slices(d, rows.where(~hand).unionByName(mark), "n", slices=5), _slices(d, rows.where(hand).unionByName(mark), "n", slices=5), 30000)
    states = d.spark.read.parquet(_through(d, made)).withColumnRenamed("_k", "n")
    value = [c for c in states.columns if c not in ("dedup_key", "n", "t", "seq")]
    last = states.groupBy("dedup_key", "n").agg(F.max_by(F.struct(*value), F.struct("t", "seq")).alias("x")).select("dedup_key", "n", "x.*")
    return last.withColumn("evidence", F.array_join("evidence", ", "))


VERSIONS = "select user_id * 3 + event_id % 3 as id, event_id as seq, case when event_id % 5 = 0 then 'resolved' when event_id % 5 = 1 then 'acked' else 'open' end as state, event_id % 7 % 2 as level, event_type as rule from events"


@query("S6_finding_changes", f"""
select id, seq, state, level, rule, case when state <> 'resolved' and coalesce(was = 'resolved', true) then 'opened' when state = 'resolved' and was <> 'resolved' then 'resolved' when state <> 'resolved' and not (was = state and l = level and r = rule) then 'changed' end as change
from (select *, lag(state) over w as was, lag(level) over w as l, lag(rule) over w as r from ({VERSIONS}) window w as (partition by id order by seq))
where (state <> 'resolved' and coalesce(was = 'resolved', true)) or (state = 'resolved' and was <> 'resolved') or (state <> 'resolved' and not (was = state and l = level and r = rule))""")
def s6_changes(d: Data):
    return finding_changes(d.sql(VERSIONS))


@query("S6_change_feed", ORACLES.get("S6_finding_changes"))
def s6_feed(d: Data):
    """The same as a stream into an idempotent sink."""
    rows, path = d.sql(VERSIONS), fresh_path(d.spark, "feed")
    feed = J.finding_feed(_slices(d, rows, "seq", slices=4, key="id"))
    J.run(feed, f"{path}/checkpoint", deliver(f"{path}/rows"))
    return d.spark.read.schema("id long, seq long, state string, level long, rule string, change string").json(f"{path}/rows").drop("batch")


@query("P9_stream_bursts", ORACLES.get("P9_failure_bursts"))
def p9_stream(d: Data):
    rows = d("events").where("event_type = 'error'").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    twice = rows.unionAll(rows.where("event_id % 10 = 3")).select("user_id", "t", F.col("event_id").alias("n"))
    made = J.bursts(_slices(d, twice, "n", slices=5), "user_id", 172800, 3)
    found = d.spark.read.parquet(_through(d, made)).select(F.col("n").alias("event_id"), "user_id", F.col("recent").cast("long").alias("recent"))
    return found


@query("M1_stream_append", """select metric, device_id, floor(epoch(ts))::BIGINT as t, max_by(v, arrival) as v from v_metric_samples where arrival % 41 <> 7 group by 1, 2, 3""")
def m1_stream(d: Data):
    """Arrivals in the order of their times, some of them NaN: nothing is late."""
    v = F.when(F.col("arrival") % 41 == 7, float("nan")).otherwise(F.col("v"))
    rows = d("v_metric_samples").select("metric", "device_id", epoch(F.col("ts")).alias("t"), "arrival", v.alias("v"))
    made = d.spark.read.parquet(_through(d, J.appended(_slices(d, rows, "arrival", slices=5, key="device_id"), ["metric", "device_id"])))
    return made.groupBy("metric", "device_id", "t").agg(F.max_by("v", "arrival").alias("v"))
