"""Queries F1 to F18."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..operators import flow as O
from .registry import Data, query

DAY, WEEK, QUARTER = 86400, 7 * 86400, 90 * 86400  # the views hold one shipment day for each flow: buckets are days and weeks
KNOWN = ", ".join(map(str, O.PORT_NAMES))
PORT = f"case when proto not in (6, 17, 132) then 0 when dst_port in ({KNOWN}) then dst_port when src_port in ({KNOWN}) then src_port when src_port <> 0 and src_port < dst_port then src_port else dst_port end"
NAME = (
    "case when proto in (6, 17, 132) and port in (" + KNOWN + ") then case port " + " ".join(f"when {k} then '{v}'" for k, v in O.PORT_NAMES.items()) + " end "
    + "else coalesce(case proto " + " ".join(f"when {k} then '{v}'" for k, v in O.PROTO_NAMES.items()) + " end, concat('ip', proto::VARCHAR)) || case when port = 0 then '' else concat('/', port::VARCHAR) end end"
)


def _t(seconds: int) -> str:
    return f"(floor(epoch(ts) / {seconds}) * {seconds})::BIGINT"


def _top(which: str, n: int, seconds: int = DAY) -> str:
    keys = ", ".join(O.TOPS[which][0])
    return f"""select * from (select *, row_number() over (partition by exporter, t order by bytes desc, {keys}) as place from (
    select exporter, t, {keys}, sum(bytes)::BIGINT as bytes, sum(packets)::BIGINT as packets, count(*) as flows from (select *, {_t(seconds)} as t, {PORT} as port from v_flow_records) group by exporter, t, {keys})) where place <= {n}"""


@query("F1_normalised_flows", """
select o_custkey as src, l_partkey as dst, (case when i = 0 then o else i end * s)::BIGINT as bytes, (case when i = 0 then op else ip end * s)::BIGINT as packets from (
select case when l_partkey % 50 = 0 then null else o_custkey end as o_custkey, l_partkey, case when l_linenumber = 3 then 0 else floor(l_extendedprice) end as i, floor(l_extendedprice) * 2 as o,
 case when l_linenumber = 4 then 0 else l_quantity end as ip, l_quantity * 2 as op, greatest(l_orderkey % 4, 1) as s from lineitem join orders on l_orderkey = o_orderkey) where o_custkey is not null""")
def f1(d: Data):
    rows = d.sql("""select case when l_partkey % 50 = 0 then null else o_custkey end as src, l_partkey as dst, case when l_linenumber = 3 then 0 else floor(l_extendedprice) end as in_bytes, floor(l_extendedprice) * 2 as out_bytes,
    case when l_linenumber = 4 then 0 else l_quantity end as in_packets, l_quantity * 2 as out_packets, l_orderkey % 4 as sampling from lineitem join orders on l_orderkey = o_orderkey""")
    return O.normalise(rows)


@query("F2_service_port", f"select proto, src_port, dst_port, ({PORT})::INT as port, count(*) as n from v_flow_records group by all")
def f2(d: Data):
    return O.with_port(d("v_flow_records")).groupBy("proto", "src_port", "dst_port", "port").agg(F.count("*").alias("n"))


@query("F3_application", f"select app, count(*) as flows, sum(bytes)::BIGINT as bytes from (select {NAME} as app, bytes from (select *, ({PORT})::INT as port from v_flow_records)) group by app")
def f3(d: Data):
    rows = O.with_port(d("v_flow_records")).select(O.app_name(F.col("proto"), F.col("port")).alias("app"), "bytes")
    return rows.groupBy("app").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"))


TOTALS = "select exporter, {} as t, sum(bytes)::BIGINT as bytes, sum(packets)::BIGINT as packets, count(*) as flows from v_flow_records group by 1, 2"


@query("F4_totals", TOTALS.format(_t(60)))
def f4(d: Data):
    return O.totals(d("v_flow_records"))


@query("F5_top_talkers", _top("talkers", 100))
def f5(d: Data):
    return O.summary(d("v_flow_records"), "talkers", DAY)


@query("F6_top_targets", _top("targets", 3))
def f6(d: Data):
    return O.summary(d("v_flow_records"), "targets", DAY, 3)


@query("F7_top_conversations", _top("conversations", 5, WEEK))
def f7(d: Data):
    return O.summary(d("v_flow_records"), "conversations", WEEK, 5)


@query("F8_top_applications", _top("apps", 50, QUARTER))
def f8(d: Data):
    return O.summary(d("v_flow_records"), "apps", QUARTER)


@query("F9_interface_totals", f"""
select exporter, t, if_index, sum(i)::BIGINT as in_bytes, sum(o)::BIGINT as out_bytes from (
 select exporter, {_t(DAY)} as t, in_if::INT as if_index, bytes as i, 0 as o from v_flow_records union all
 select exporter, {_t(DAY)}, out_if, 0, bytes from v_flow_records where out_if <> in_if or out_if = 0) group by 1, 2, 3""")
def f9(d: Data):
    return O.interface_totals(d("v_flow_records"), DAY)


@query("F10_key_overflow", f"""
select exporter, t, count(*) as keys, count(*) > 40 as overflow from (select distinct exporter, {_t(QUARTER)} as t, src, dst, proto, {PORT} as port from v_flow_records) group by 1, 2""")
def f10(d: Data):
    return O.key_overflow(d("v_flow_records"), 40, QUARTER)


@query("F11_folded_talkers", f"""
select * from (select *, row_number() over (partition by exporter, t order by bytes desc, src) as place from (
 select exporter, (floor(t / {WEEK}) * {WEEK})::BIGINT as t, src, sum(bytes)::BIGINT as bytes, sum(packets)::BIGINT as packets, sum(flows)::BIGINT as flows from ({_top("talkers", 2)}) group by 1, 2, 3)) where place <= 3""")
def f11(d: Data):
    return O.fold(O.summary(d("v_flow_records"), "talkers", DAY, 2), "talkers", "t", WEEK, 3)


NOW = 946684800  # 2000-01-01


@query("F12_window_totals", f"""
with m as ({TOTALS.format(_t(60))}), v as ({TOTALS.format(_t(300))}),
f as (select exporter, min(t) as first from m where t > {NOW} - 3600 and t <= {NOW} group by 1),
u as (select m.*, 60 as span from m where t > {NOW} - 3600 and t <= {NOW} union all
      select v.*, 300 from v left join f using (exporter) where t > {NOW} - 3600 and t <= {NOW} and (first is null or t + 300 <= first)),
l as (select *, 300 as span from v where t > {NOW} - 8640000 and t <= {NOW})
select exporter, '1h' as win, sum(bytes)::BIGINT as bytes, sum(packets)::BIGINT as packets, sum(flows)::BIGINT as flows, least(sum(span), 3600)::BIGINT as covered from u group by 1 union all
select exporter, '100d', sum(bytes)::BIGINT, sum(packets)::BIGINT, sum(flows)::BIGINT, least(sum(span), 8640000)::BIGINT from l group by 1""")
def f12(d: Data):
    rows = d("v_flow_records")
    minutes, fives = O.totals(rows, 60), O.totals(rows, 300)
    short = O.window_totals(minutes, fives, NOW, 3600).withColumn("win", F.lit("1h"))
    return short.unionByName(O.window_totals(minutes, fives, NOW, 8640000).withColumn("win", F.lit("100d")))


@query("F13_throughput", f"select t, sum(bytes)::BIGINT as bytes, sum(packets)::BIGINT as packets, max(span) as span from (select *, case when exporter % 2 = 0 then 60 else 300 end as span from ({TOTALS.format(_t(DAY))})) group by t")
def f13(d: Data):
    return O.throughput(O.totals(d("v_flow_records"), DAY).withColumn("span", F.when(F.col("exporter") % 2 == 0, 60).otherwise(300)))


START, STOP = 940032000, 946684800


@query("F14_idle_buckets", f"""
with m as ({TOTALS.format(_t(DAY))}), f as (select exporter, greatest(min(t), {START}) as lo from m group by 1),
c as (select exporter, unnest(range(lo, {STOP} + 1, {DAY}))::BIGINT as t from f where lo <= {STOP})
select exporter, t, coalesce(bytes, 0)::BIGINT as bytes, coalesce(packets, 0)::BIGINT as packets, coalesce(flows, 0)::BIGINT as flows from c left join m using (exporter, t)""")
def f14(d: Data):
    return O.fill_idle(O.totals(d("v_flow_records"), DAY), DAY, START, STOP)


@query("F15_exporters", f"select exporter, max(t) as last_seen, sum(flows)::BIGINT as records, sum(case when t > {NOW} - 8640000 then bytes else 0 end)::BIGINT as recent_bytes from ({TOTALS.format(_t(DAY))}) group by 1")
def f15(d: Data):
    return O.exporters(O.totals(d("v_flow_records"), DAY), NOW, 8640000)


@query("F16_named_interfaces", f"""
select n.exporter, n.t, n.if_index, n.in_bytes, n.out_bytes, v.name as device, i.name as interface from (
 select exporter, t, if_index, sum(i)::BIGINT as in_bytes, sum(o)::BIGINT as out_bytes from (
  select exporter, {_t(QUARTER)} as t, in_if::INT as if_index, bytes as i, 0 as o from v_flow_records union all
  select exporter, {_t(QUARTER)}, out_if, 0, bytes from v_flow_records where out_if <> in_if or out_if = 0) group by 1, 2, 3) n
left join v_devices v on v.device_id = n.exporter left join v_interfaces i on i.device_id = n.exporter and i.if_index = n.if_index""")
def f16(d: Data):
    return O.with_names(O.interface_totals(d("v_flow_records"), QUARTER), d("v_devices"), d("v_interfaces"))


@query("F17_unknown_exporters", "select exporter, count(*) as records from v_flow_records where exporter not in (select device_id from v_devices where monitored) group by 1")
def f17(d: Data):
    return O.unknown_exporters(d("v_flow_records"), d("v_devices").where("monitored"))


@query("F18_traffic_share", "select src, bytes, round(bytes / (sum(bytes) over ()) * 100, 6) as share_pct from (select src, sum(bytes)::BIGINT as bytes from v_flow_records group by 1) order by bytes desc, src limit 20")
def f18(d: Data):
    return O.traffic_share(d("v_flow_records"), "src")
