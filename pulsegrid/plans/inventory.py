"""Queries D1 to D11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as O
from .registry import Data, query


@query("D1_device_list", "select device_id, name from v_devices where status = 'up' and (contains(lower(name), '00') or contains(ip, '00')) and site_id <= 9 and role = 'access'")
def d1(d: Data):
    return O.device_list(d("v_devices"), status="up", role="access", text="00").select("device_id", "name")


SYS = "select s_suppkey as device_id, concat('.1.3.6.1.4.1.', cast(9 + s_suppkey % 4 as varchar(9)), '.1.', cast(s_suppkey % 5 as varchar(9))) as oid, case when s_suppkey % 6 = 0 then 'Acme OS, Version 15.2(4)E7, RELEASE' when s_suppkey % 6 = 1 then concat('Box v', cast(s_suppkey as varchar(9)), '.0.1 build') when s_suppkey % 6 = 2 then 'Linux version 5.10 x' else 'none' end as descr from supplier"
PROFILES = [("cisco", 10, "1.3.6.1.4.1.9", None), ("cisco-sub", 10, "1.3.6.1.4.1.9.1", None), ("ten", 10, "1.3.6.1.4.1.10", None), ("linux", 10, "9.9", "^Linux"), ("eleven-first", 20, "1.3.6.1.4.1.11.1", None), ("short-ones", 10, "1.3.6.1.4", None), ("short-ones", 10, "1.3.6.1.4.1", None), ("short-ones", 10, "1.3.6", None)]


@query("D2_profiles", f"select device_id, case when device_id % 4 = 2 then 'eleven-first' when device_id % 6 = 2 then 'linux' when device_id % 4 = 0 then 'cisco-sub' when device_id % 4 = 1 then 'ten' else 'short-ones' end as profile from ({SYS})")
def d2(d: Data):
    return O.match_profile(d.sql(SYS), d.spark.createDataFrame(PROFILES, "profile string, priority int, prefix string, pattern string"))


@query("D3_os_versions", f"select device_id, case device_id % 6 when 0 then '15.2(4)E7' when 1 then device_id::VARCHAR || '.0.1' when 2 then '5.10' else '' end as version from ({SYS})")
def d3(d: Data):
    return d.sql(SYS).select("device_id", O.os_version(F.col("descr")).alias("version"))


TYPES = "select p_partkey as id, cast(p_size as int) as if_type, case when p_partkey % 2 = 0 then 'Null0' else 'x1' end as name from part"


@query("D4_interface_kinds", f"select id, case when if_type in (6, 117, 0) then 'phys' when if_type = 161 then 'lag' when if_type in (53, 135, 136) then 'vlan' when if_type in (131, 150) then 'tunnel' when if_type = 24 then 'loopback' when if_type = 1 and id % 2 = 0 then 'skip' else 'other' end as kind from ({TYPES})")
def d4(d: Data):
    return d.sql(TYPES).select("id", O.interface_kind(F.col("if_type"), F.col("name")).alias("kind"))


SPECS = """select concat('10.0.', cast(n_nationkey as varchar(9)), '.8/30') as spec from nation union all select concat('10.1.', cast(n_nationkey as varchar(9)), '.1-10.1.', cast(n_nationkey as varchar(9)), '.3') from nation
 union all select concat('10.2.0.', cast(n_nationkey as varchar(9))) from nation union all select concat(' 10.3.', cast(n_nationkey as varchar(9)), '.5-9') from nation union all select concat('10.', cast(n_nationkey as varchar(9)), '.0.0/16') from nation
 union all select concat('host', cast(n_nationkey as varchar(9))) from nation union all select concat('10.4.0.7-x', cast(n_nationkey as varchar(9))) from nation union all select concat('10.5.', cast(n_nationkey as varchar(9)), '.0/31') from nation"""


@query("D5_addresses", f"""
with s as (select spec, trim(spec) as t, string_split(string_split(trim(spec), '-')[1], '.') as p from ({SPECS})),
i as (select unnest(range(0, 10)) as i)
select spec, array_to_string(p[1:3], '.') || '.' || i::VARCHAR as ip, null as error from s, i where
 (ends_with(t, '/30') and i in (9)) or (contains(t, '-10.') and i between 1 and 3) or (ends_with(t, '.5-9') and i between 5 and 9) or (ends_with(t, '.0/31') and i <= 1)
 union all select spec, array_to_string(p[1:3], '.') || '.10', null from s where ends_with(t, '/30') union all select spec, t, null from s where starts_with(t, '10.2.0.') and not contains(t, '/')
 union all select spec, null, case when ends_with(t, '/16') then 'network too large' when starts_with(t, 'host') then 'not an address' else 'bad range end' end from s where ends_with(t, '/16') or starts_with(t, 'host') or contains(t, '-x')""")
def d5(d: Data):
    return O.expand_addresses(d.sql(SPECS))


@query("D6_registered", """
select ip, seen, row_number() over (order by seen, ip) + (select count(*) from v_devices where device_id % 2 = 0) <= (select count(*) from v_devices where device_id % 2 = 0) + 20 as monitored from (
 select '10.5.0.' || user_id::VARCHAR as ip, min(event_id) as seen from events where user_id % 5 <> 0 group by 1)""")
def d6(d: Data):
    found = d("events").select(F.concat(F.lit("10.5.0."), F.col("user_id").cast("string")).alias("ip"), F.col("event_id").alias("seen"))
    known = d("v_devices").where("device_id % 2 = 0").select("ip").unionAll(found.where("substring_index(ip, '.', -1) % 5 = 0").select("ip").distinct())
    n = d("v_devices").where("device_id % 2 = 0").count()
    extra = known.count() - n
    return O.register(found, known, n + extra + 20)


@query("D7_capacity", "select device_id, row_number() over (order by created, device_id) <= 7 as monitored from (select s_suppkey as device_id, s_suppkey * 37 % 11 as created from supplier)")
def d7(d: Data):
    return O.capacity(d("supplier").select(F.col("s_suppkey").alias("device_id"), (F.col("s_suppkey") * 37 % 11).alias("created")), 7)


@query("D8_overview", """
select case when not monitored then 'unmonitored' else status end as what, count(*) as n from v_devices group by 1 union all
select 'alert:' || severity, count(*) from v_alerts where state <> 'resolved' and root_cause is null group by 1""")
def d8(d: Data):
    return O.overview(d("v_devices"), d("v_alerts"))


HEALTH = """select *, in_bps / (speed_mbps * 1000000.0e0) * 100 as in_util, out_bps / (speed_mbps * 1000000.0e0) * 100 + (if_index % 3) as out_util, in_bps / 800 as in_pps, out_bps / 900 as out_pps,
 err_rate * 0.5e0 as in_err, err_rate * 0.25e0 as out_err, case when (device_id + if_index) % 4 = 0 then 1.5e0 else 0.0e0 end as in_drop, case when if_index = 7 then 2.0e0 else 0.0e0 end as out_drop from v_interfaces"""
_SUMS = ", ".join(f"round(sum(case when port and oper_up then {c} else 0.0 end), 3) as {c}" for c in O.RATES)


@query("D9_device_health", f"""
with i as (select *, kind in ('phys', 'lag') as port, admin_up and not oper_up and kind in ('phys', 'lag') as is_down, greatest(in_util, out_util) as util from ({HEALTH})),
b as (select device_id, string_agg(name, ',' order by k) as busiest from (select *, row_number() over (partition by device_id order by floor(util) desc, in_err + out_err + in_drop + out_drop > 0 desc, in_bps + out_bps desc, name) as k from i where port and oper_up and speed_mbps > 0 and util > 0) where k <= 3 group by 1),
w as (select device_id, string_agg(name, ',' order by k) as down_ports from (select *, row_number() over (partition by device_id order by not important, name) as k from i where is_down) where k <= 6 group by 1),
s as (select device_id, count(*) as total, sum((admin_up and oper_up)::INT)::BIGINT as up, sum(is_down::INT)::BIGINT as down, sum((not admin_up)::INT)::BIGINT as admin_down, sum(important::INT)::BIGINT as important, sum((is_down and important)::INT)::BIGINT as important_down,
 {_SUMS}, bool_or(port and oper_up and (in_bps > 0 or out_bps > 0 or in_pps > 0 or out_pps > 0)) as have_rates from i group by 1),
a as (select device_id, count(*) as alerts, max_by(severity, case severity when 'critical' then 4 when 'major' then 3 when 'minor' then 2 else 1 end) as worst from v_alerts where state <> 'resolved' group by 1)
select d.device_id, total, up, down, admin_down, important, important_down, {", ".join(O.RATES)}, have_rates, case when total is not null then coalesce(busiest, '') end as busiest, case when total is not null then coalesce(down_ports, '') end as down_ports, case when total is not null then greatest(down - 6, 0) end as down_more, coalesce(alerts, 0) as alerts, worst
from v_devices d left join s using (device_id) left join b using (device_id) left join w using (device_id) left join a using (device_id)""")
def d9(d: Data):
    return O.device_health(d("v_devices"), d.sql(HEALTH), d("v_alerts"))


@query("D10_device_detail", """
select d.device_id, d.name, s.name as site, p.ports, coalesce(e.n, 0) as events from v_devices d left join v_sites s using (site_id)
left join (select device_id, string_agg(name, ',' order by name) as ports from v_interfaces group by 1) p using (device_id) left join (select device_id, count(*) as n from v_log_entries group by 1) e using (device_id)""")
def d10(d: Data):
    return O.device_detail(d("v_devices"), d("v_sites"), d("v_interfaces"), d("v_log_entries"))


@query("D11_interface_inventory", """
with o as (select device_id, if_index, name, case when oper_up then 'up' else 'down' end as status from v_interfaces where if_index <= 5), n as (select device_id, if_index, name from v_interfaces where device_id % 2 = 0 and if_index >= 3)
select n.device_id, n.if_index, n.name, coalesce(o.status, 'unknown') as status from n left join o using (device_id, if_index) union all select * from o where device_id % 2 <> 0""")
def d11(d: Data):
    ports = d("v_interfaces")
    old = ports.where("if_index <= 5").withColumn("status", F.when(F.col("oper_up"), "up").otherwise("down"))
    return O.upsert_interfaces(ports.where("device_id % 2 = 0 and if_index >= 3"), old)
