"""Queries S1 to S8: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import epoch
from ..operators import metrics as M
from ..sources import files as S
from ..sources.storage import fresh_path
from .registry import Data, query


def _journal(d: Data):
    rows = d("events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), "ts", "user_id", "event_type")
    path = fresh_path(d.spark, "journal")
    S.write_journal(rows, path, "ts")
    return path, rows.drop("ts").schema


@query("S1_journal_scan", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, user_id, event_type, strftime(ts, '%Y-%m-%d') as day from events where strftime(ts, '%Y-%m-%d') between '2024-01-05' and '2024-01-09'")
def s1(d: Data):
    path, schema = _journal(d)
    return S.read_journal(d.spark, path, schema, "2024-01-05", "2024-01-09")


@query("S2_journal_sink", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n, sum(event_id)::BIGINT as ids from events group by 1")
def s2(d: Data):
    path, schema = _journal(d)
    return S.read_journal(d.spark, path, schema, "0000-01-01", "9999-12-31").groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("S3_estate_export", "select s.name as site, d.device_id, i.if_index, i.name from v_sites s left join v_devices d using (site_id) left join v_interfaces i using (device_id)")
def s3(d: Data):
    path = fresh_path(d.spark, "estate")
    S.export_estate(d("v_sites"), d("v_devices"), d("v_interfaces"), path)
    return S.read_estate(d.spark, path)


@query("S4_tiered_files", """
select 'raw' as tier, metric || '|' || device_id::VARCHAR as series, floor(epoch(ts))::BIGINT as t, v from v_metric_samples where strftime(ts, '%Y-%m-%d') between '2024-01-20' and '2024-01-22' union all
select 'rollup', metric || '|' || device_id::VARCHAR, (floor(epoch(ts) / 300) * 300)::BIGINT, round(avg(v), 6) from v_metric_samples where strftime(ts, '%Y-%m-%d') between '2024-01-03' and '2024-01-04' group by 2, 3""")
def s4(d: Data):
    rows = d("v_metric_samples").select(F.concat_ws("|", "metric", F.col("device_id").cast("string")).alias("series"), "ts", "v")
    path = fresh_path(d.spark, "tiers")
    S.write_tiers(rows.select("series", epoch(F.col("ts")).alias("t"), "v"), M.rollup(rows, ["series"]), path)
    both = S.read_tiers(d.spark, path, "raw", "2024-01-20", "2024-01-22").unionByName(S.read_tiers(d.spark, path, "rollup", "2024-01-03", "2024-01-04"))
    return both.select("tier", "series", "t", "v")


NOW = 1706572800


@query("S5_retention", f"""select 'raw' as dataset, count(*) as kept from events where epoch(ts) >= {(NOW // 86400 - 14) * 86400} union all select 'logs', count(*) from events where epoch(ts) >= {(NOW // 86400 - 30) * 86400}""")
def s5(d: Data):
    made = [S.retained(d("events"), "ts", name, NOW).agg(F.lit(name).alias("dataset"), F.count("*").alias("kept")) for name in ("raw", "logs")]
    return made[0].unionByName(made[1])


@query("S5_pruned_journal", f"select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where epoch(ts) >= {(NOW // 86400 - 14) * 86400} group by 1")
def s5_pruned(d: Data):
    path, schema = _journal(d)
    S.prune_days(d.spark, path, "raw", NOW)
    return S.read_journal(d.spark, path, schema, "0000-01-01", "9999-12-31").groupBy("day").agg(F.count("*").alias("n"))


@query("S6_finding_sink", "select id, severity, root_cause is not null as has_root from v_alerts where state = 'open'")
def s6(d: Data):
    path = fresh_path(d.spark, "findings")
    S.write_findings(d("v_alerts").where("state = 'open'").select("id", "severity", "root_cause"), path)
    lines = d.spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.severity").alias("severity"), F.col("value").contains("root_cause").alias("has_root"))


@query("S7_report_csv", "select device_id::VARCHAR as device_id, name, role from v_devices")
def s7(d: Data):
    path = fresh_path(d.spark, "report")
    S.write_table(d("v_devices").select("device_id", "name", "role"), path)
    return d.spark.read.option("header", True).csv(path)


WALKED = """select device_id as device, concat('1.3.6.1.2.1.2.2.1.2.', cast(if_index as varchar(9))) as oid, name as value from v_interfaces union all
select device_id, concat('1.3.6.1.2.1.2.2.1.5.', cast(if_index as varchar(9))), cast(speed_mbps as varchar(20)) from v_interfaces union all select device_id, '1.3.6.1.2.1.1.1.0', 'descr' from v_interfaces"""


@query("S8_walk_pivot", "select device_id as device, if_index::VARCHAR as idx, name, speed_mbps::VARCHAR as speed from v_interfaces")
def s8(d: Data):
    return S.pivot_walk(d.sql(WALKED), "1.3.6.1.2.1.2.2.1", {2: "name", 5: "speed"})
