"""Queries M1 to M17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import epoch, top_bits
from ..operators import metrics as M
from ..sources import files
from ..sources.storage import fresh_path
from .registry import ORACLES, Data, query

NOW = 1706572800  # 2024-01-30 00:00 UTC
_T = "floor(epoch(ts))::BIGINT"


@query("M1_append_rules", f"""
with s as (select metric, device_id, {_T} + case when arrival % 97 = 0 then 7200 else 0 end as t, arrival + arrival * 7919 % 40 + arrival / 1e7 as arrival, case when arrival % 97 = 0 then 'NaN'::DOUBLE else v end as v from v_metric_samples),
h as (select *, floor(max(t) over (order by arrival rows between unbounded preceding and 1 preceding) / 3600) * 3600 as head from s),
o as (select *, max(t) over (partition by metric, device_id order by arrival rows between unbounded preceding and 1 preceding) as own from h where (head is null or t >= head) and not isnan(v))
select metric, device_id, t, max_by(v, arrival) as v from o where own is null or t >= own group by metric, device_id, t""")
def m1(d: Data):
    void = F.col("arrival") % 97 == 0  # a NaN of a later hour, now and then
    rows = d("v_metric_samples").select("metric", "device_id", (epoch(F.col("ts")) + F.when(void, 7200).otherwise(0)).alias("t"), (F.col("arrival") + F.col("arrival") * 7919 % 40 + F.col("arrival") / 1e7).alias("arrival"), F.when(void, float("nan")).otherwise(F.col("v")).alias("v"))
    return M.accept_samples(rows, ["metric", "device_id"])


@query("M2_quantised_values", """
with x as (select arrival, v, abs(v::FLOAT::DOUBLE) as a from v_metric_samples), y as (select *, floor(log2(a)) as e0 from x),
z as (select *, e0 - (pow(2, e0) > a)::INT + (pow(2, e0 + 1) <= a)::INT as e from y)
select arrival, sign(v) * floor(a / pow(2, e - 12)) * pow(2, e - 12) as q from z""")
def m2(d: Data):
    return d("v_metric_samples").select("arrival", top_bits(F.col("v")).alias("q"))


ROLLUP = "select metric, device_id, (floor(epoch(ts) / 300) * 300)::BIGINT as t, round(avg(v), 6) as v, min(v) as min, max(v) as max from v_metric_samples {} group by 1, 2, 3"


@query("M3_rollup", ROLLUP.format(""))
def m3(d: Data):
    return M.rollup(d("v_metric_samples"), ["metric", "device_id"])


@query("M4_merged_rollup", f"""
with fresh as ({ROLLUP.format("where device_id % 3 = 0")}),
stored as (select metric, device_id, t, v + 1 as v, min, max from ({ROLLUP.format("")}))
select metric, device_id, t, v, min, max from fresh union all
select s.metric, s.device_id, s.t, s.v, s.min, s.max from stored s where not exists (select 1 from fresh f where f.metric = s.metric and f.device_id = s.device_id and f.t = s.t)""")
def m4(d: Data):
    rows = d("v_metric_samples")
    keys = ["metric", "device_id"]
    stored = M.rollup(rows, keys).withColumn("v", F.col("v") + 1)
    return M.merge_rollup(M.rollup(rows.where("device_id % 3 = 0"), keys), stored, [*keys, "t"])


@query("M4_stored_rollup", ORACLES["M4_merged_rollup"].replace("where device_id % 3 = 0", "where device_id % 3 = 0 and event_day(ts)").replace("event_day(ts)", "arrival % 5 < 2"))
def m4_stored(d: Data):
    """The merge in place: the stored table by day, then a job with fresh buckets, run twice."""
    rows, keys, path = d("v_metric_samples"), ["metric", "device_id"], fresh_path(d.spark, "rollup")
    files.replace_buckets(M.rollup(rows, keys).withColumn("v", F.col("v") + 1), path, keys, "first")
    for _ in range(2):
        files.replace_buckets(M.rollup(rows.where("device_id % 3 = 0 and arrival % 5 < 2"), keys), path, keys, "fresh")
    return d.spark.read.parquet(path).drop("day")


RAW = f"select metric, device_id, {_T} as t, v from v_metric_samples"


def _tiers(d: Data):
    rows = d("v_metric_samples")
    raw = rows.select("metric", "device_id", epoch(F.col("ts")).alias("t"), "v")
    return M.tiered_range(raw, M.rollup(rows, ["metric", "device_id"]), 1704500000, 1706000000, 1705300000)


TIERS = f"""select metric, device_id, t, v, min, max, 'rollup' as tier from ({ROLLUP.format("")}) where t between 1704500000 and 1706000000 and t < 1705276800
union all select metric, device_id, t, v, v, v, 'raw' from ({RAW}) where t between 1705276800 and 1706000000"""


@query("M5_tiered_range", TIERS)
def m5(d: Data):
    return _tiers(d)


@query("M6_last_values", "select metric, device_id, max_by(v, (ts, arrival)) as v from v_metric_samples group by metric, device_id")
def m6(d: Data):
    return d("v_metric_samples").groupBy("metric", "device_id").agg(F.max_by("v", F.struct("ts", "arrival")).alias("v"))


@query("M7_series_count", "select count(*) as series from (select distinct metric, device_id from v_metric_samples)")
def m7(d: Data):
    return d("v_metric_samples").agg(F.countDistinct("metric", "device_id").alias("series"))


@query("M8_multi_series", f"""select concat(metric, '|', device_id::VARCHAR) as series, t, v from ({RAW})
where device_id in (3, 5, 7) and metric in ('view', 'error') and t >= greatest({NOW} - 86400 * 3, {NOW} - 86400 * 2) and t <= {NOW}""")
def m8(d: Data):
    rows = d("v_metric_samples").select(F.concat_ws("|", "metric", F.col("device_id").cast("string")).alias("series"), epoch(F.col("ts")).alias("t"), "v")
    names = [f"{m}|{k}" for m in ("view", "error") for k in (3, 5, 7)]
    return M.fetch_series(rows, names, NOW - 86400 * 3, NOW, 86400 * 2)


@query("M9_counter_rates", """
with p as (select device_id, if_index, ts, in_oct32, in_oct64, in_err, epoch(ts) - lag(epoch(ts)) over w as dt, lag(in_oct32) over w as p32, lag(in_oct64) over w as p64, lag(in_err) over w as pe, uptime < lag(uptime) over w as rebooted
  from v_if_counters window w as (partition by device_id, if_index order by ts))
select device_id, if_index, ts,
  case when dt >= 1 and not rebooted then round((case when in_oct32 >= p32 then in_oct32 - p32 else 4294967295 - p32 + in_oct32 + 1 end) * 8 / dt, 6) end as bps32,
  case when dt >= 1 and not rebooted then round((case when in_oct64 >= p64 then in_oct64 - p64 else 0 end) * 8 / dt, 6) end as bps64,
  case when dt >= 1 and not rebooted then round((case when in_err >= pe then in_err - pe else 4294967295 - pe + in_err + 1 end) / dt, 6) end as err_rate from p""")
def m9(d: Data):
    return M.counters_to_rates(d("v_if_counters"))


@query("M10_utilisation", "select device_id, if_index, case when speed_mbps > 0 then in_bps / (speed_mbps * 1000000) * 100 else 0.0 end as in_util, case when speed_mbps > 0 then out_bps / (speed_mbps * 1000000) * 100 else 0.0 end as out_util from v_interfaces")
def m10(d: Data):
    return d("v_interfaces").select("device_id", "if_index", M.utilisation(F.col("in_bps"), F.col("speed_mbps")).alias("in_util"), M.utilisation(F.col("out_bps"), F.col("speed_mbps")).alias("out_util"))


THINNED = f"""
with recursive s as (select metric, device_id, {_T} as t, arrival, v, device_id % 10 = 0 as important, row_number() over (partition by metric, device_id order by {_T}, arrival) as n from v_metric_samples),
f as (select metric, device_id, t, arrival, v, important, n, true as kept, t as last from s where n = 1 union all
  select s.metric, s.device_id, s.t, s.arrival, s.v, s.important, s.n, s.important or s.t - f.last >= 21600, case when s.important or s.t - f.last >= 21600 then s.t else f.last end
  from f join s on s.metric = f.metric and s.device_id = f.device_id and s.n = f.n + 1)"""
RATES = {"in_bps": "v", "out_bps": "v * 2", "in_err": "arrival % 3", "out_err": "arrival % 2", "in_drop": "arrival % 5 - 2", "out_drop": "0", "in_pps": "v / 8", "out_pps": "v / 4"}


def _thinned(d: Data):
    rows = d("v_metric_samples").select("metric", "device_id", epoch(F.col("ts")).alias("t"), "arrival", "v", (F.col("device_id") % 10 == 0).alias("important"))
    return M.thin_history(rows, ["metric", "device_id"], ["arrival"], 21600)


@query("M11_thinned_history", THINNED + " select metric, device_id, t, arrival from f where kept")
def m11(d: Data):
    return _thinned(d).select("metric", "device_id", "t", "arrival")


@query("M11_kept_series", THINNED + """, k as (select metric, device_id, t, important, """ + ", ".join(f"cast({e} as double) as {n}" for n, e in RATES.items()) + """ from f where kept)
select metric, device_id, t, series, v from (""" + " union all ".join(f"select metric, device_id, t, 'if_{n}' as series, {n} as v from k where {w}" for n, w in (
    ("in_bps", "true"), ("out_bps", "true"), ("in_err", "in_err > 0 or out_err > 0"), ("out_err", "in_err > 0 or out_err > 0"), ("in_drop", "in_drop > 0 or out_drop > 0"), ("out_drop", "in_drop > 0 or out_drop > 0"), ("in_pps", "important"), ("out_pps", "important"))) + ")")
def m11_series(d: Data):
    return M.kept_series(_thinned(d).selectExpr("*", *[f"cast({e} as double) as {n}" for n, e in RATES.items()]), ["metric", "device_id"])


@query("M12_reboots", f"""
with s as (select sample_id, device_id, ts, sample_id * 97 % 5000 as uptime from v_device_samples),
p as (select *, lag(uptime) over (partition by device_id order by ts, sample_id) as prev_uptime from s)
select * from p where prev_uptime > 0 and uptime < prev_uptime - 5 and uptime < 86400""")
def m12(d: Data):
    return M.reboots(d("v_device_samples").select("sample_id", "device_id", "ts", (F.col("sample_id") * 97 % 5000).alias("uptime")))


@query("M13_series_stats", f"select metric, device_id, round(avg(v), 6) as mean, max(greatest(v, max)) as peak from ({TIERS}) group by 1, 2")
def m13(d: Data):
    return M.series_stats(_tiers(d), ["metric", "device_id"])


PROFILE = [("view", 0.5, "avg"), ("error", 2.0, "max"), ("click", 1.0, "sum"), ("signup", 10.0, "first")]


@query("M14_profile_metrics", """
with p(metric, scale, how) as (values ('view', 0.5, 'avg'), ('error', 2.0, 'max'), ('click', 1.0, 'sum'), ('signup', 10.0, 'first'))
select device_id, metric, how, round(case how when 'avg' then avg(v * scale) when 'max' then max(v * scale) when 'sum' then sum(v * scale) else min_by(v * scale, arrival) end + 1e-9, 6) as value
from v_metric_samples join p using (metric) group by device_id, metric, how""")
def m14(d: Data):
    profile = d.spark.createDataFrame(PROFILE, "metric string, scale double, how string")
    made = M.profile_metrics(d("v_metric_samples").withColumnRenamed("arrival", "at"), profile)
    return made.withColumn("value", F.round(F.col("value") + 1e-9, 6))  # the engines round exact halves differently


LOADS = """select device_id, case when event_n = 0 then 'ALL' else cast(event_n as varchar(9)) end as cpu, cpu_v, used, free, reserved, mem_given, physical from (
select user_id as device_id, event_id % 4 as event_n, cast(floor(value) as double) as cpu_v, case when user_id % 2 = 0 then cast(event_id % 100 as double) end as used, case when user_id % 4 = 0 then cast(event_id % 60 as double) end as free,
case when user_id % 3 = 0 then 40.0e0 end as reserved, case when user_id % 5 = 0 then 55.5e0 end as mem_given, 200.0e0 as physical from events where user_id % 7 <> 0 or event_id % 4 <> 0) x"""


@query("M15_load_percent", f"""
with l as ({LOADS}), g as (select device_id, max(case when cpu = 'ALL' then cpu_v end) as a, avg(case when cpu <> 'ALL' then cpu_v end) as b, max(used) as u, max(free) as f, max(reserved) as r, max(mem_given) as m, max(physical) as p from l group by device_id)
select device_id, round(coalesce(a, b), 6) as cpu_pct, round(coalesce(case when u + f > 0 then u / (u + f) * 100 end, m, case when p > 0 then coalesce(u, r) / p * 100 end), 6) as mem_pct from g""")
def m15(d: Data):
    return M.load_percent(d.sql(LOADS))


@query("M16_echo_statistics", """
with a as (select device_id, strftime(ts, '%Y-%m-%d') as day, ts, sample_id, reachable, rtt_ms from v_device_samples),
s as (select device_id, day, rtt_ms, lag(rtt_ms) over (partition by device_id, day order by ts, sample_id) as p from a where reachable),
n as (select device_id, day, count(*) as sent from a group by 1, 2),
g as (select device_id, day, count(*) as got, min(rtt_ms) as min_ms, max(rtt_ms) as max_ms, avg(rtt_ms) as avg_ms, avg(abs(rtt_ms - p)) as jitter from s group by 1, 2)
select device_id, day, round((sent - coalesce(got, 0)) / sent * 100.0, 6) as loss_pct, min_ms, max_ms, round(avg_ms, 6) as avg_ms, coalesce(round(jitter, 6), 0.0) as jitter_ms from n left join g using (device_id, day)""")
def m16(d: Data):
    rows = d("v_device_samples").withColumn("day", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return M.echo_statistics(rows, ["device_id", "day"], ["ts", "sample_id"])


@query("M17_samples_to_series", """
select concat(metric, '|', device_id::VARCHAR) as series, ts, v from (
  select device_id, ts, 'rtt_ms' as metric, case when reachable then rtt_ms end as v from v_device_samples union all
  select device_id, ts, 'cpu_pct', case when snmp_ok then cpu_pct end from v_device_samples union all select device_id, ts, 'loss_pct', loss_pct from v_device_samples) where v is not null""")
def m17(d: Data):
    rows = d("v_device_samples").select("device_id", "ts", F.when(F.col("reachable"), F.col("rtt_ms")).alias("rtt_ms"), F.when(F.col("snmp_ok"), F.col("cpu_pct")).alias("cpu_pct"), F.col("loss_pct").cast("double").alias("loss_pct"))
    return M.samples_to_series(rows, ["rtt_ms", "cpu_pct", "loss_pct"], "device_id")
