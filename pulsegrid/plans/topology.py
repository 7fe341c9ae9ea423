"""Queries T1 to T18."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import PORT_PREFIXES, is_mac, short_host, short_port
from ..operators import topology as O
from .registry import Data, query

SHORT = "lower(case " + " ".join(f"when starts_with({{0}}, '{a}') then '{b}' || {{0}}[{len(a) + 1}:]" for a, b in PORT_PREFIXES) + " else {0} end)"


@query("T1_short_ports", f"select device_id, if_index, {SHORT.format('trim(name)')} as port from v_interfaces")
def t1(d: Data):
    return d("v_interfaces").select("device_id", "if_index", short_port(F.col("name")).alias("port"))


HOSTS = "select s_suppkey as id, concat(case s_suppkey % 3 when 0 then '.Lead' else 'SW-' end, cast(s_suppkey as varchar(9)), case when s_suppkey % 2 = 0 then '.Example.net' else '' end) as host, case when s_suppkey % 2 = 0 then '00:1A:2b:3c:4d:5e' else '001a.2b3c.4d5' end as mac from supplier"


@query("T2_short_hosts", f"select id, case when instr(lower(host), '.') > 1 then split_part(lower(host), '.', 1) else lower(host) end as host, id % 2 = 0 as is_mac from ({HOSTS})")
def t2(d: Data):
    return d.sql(HOSTS).select("id", short_host(F.col("host")).alias("host"), is_mac(F.col("mac")).alias("is_mac"))


OBS = """select s_suppkey as device_id, cast(floor(s_suppkey / 3) as bigint) as true_id, case when s_suppkey % 4 = 0 then concat('AA', lpad(cast(cast(floor(s_suppkey / 3) as bigint) as varchar(9)), 10, '0')) end as remote_mac,
 case when s_suppkey % 4 = 1 then concat('10.9.9.', cast(cast(floor(s_suppkey / 3) as bigint) as varchar(9))) end as remote_ip,
 case when s_suppkey % 4 = 2 then concat('Supplier#', lpad(cast(cast(floor(s_suppkey / 3) as bigint) as varchar(9)), 9, '0'), '.corp.net') when s_suppkey % 8 = 3 then concat('supplier#', lpad(cast(cast(floor(s_suppkey / 3) as bigint) as varchar(9)), 9, '0'), '(SN1)') when s_suppkey % 8 = 7 then concat('stranger', cast(s_suppkey % 3 as varchar(9))) end as remote_name from supplier"""


def _resolved(d: Data):
    devices = d("v_devices").select("device_id", "name", F.lower(F.concat(F.lit("aa"), F.lpad(F.col("device_id").cast("string"), 10, "0"))).alias("mac"), F.concat(F.lit("10.9.9."), F.col("device_id").cast("string")).alias("ip"))
    return O.resolve_neighbours(d.sql(OBS), devices)


@query("T3_resolved_neighbours", f"select device_id, case when device_id % 8 = 7 then null else true_id end as remote from ({OBS})")
def t3(d: Data):
    return _resolved(d).select("device_id", F.col("remote").cast("long").alias("remote"))


MAC_PORTS = "select *, concat('00:1B:00:00:', lpad(cast(device_id % 100 as varchar(9)), 2, '0'), ':', lpad(cast(if_index as varchar(9)), 2, '0')) as mac from v_interfaces"
REFS = f"select device_id, if_index, case if_index % 4 when 0 then concat('ifindex:', cast(if_index as varchar(9))) when 1 then replace(name, 'GigabitEthernet', 'gi') when 2 then lower(mac) else 'odd' end as ref from ({MAC_PORTS})"


@query("T4_resolved_ports", f"select r.device_id, r.if_index, case r.if_index % 4 when 3 then 'odd' else i.name end as port from ({REFS}) r join v_interfaces i using (device_id, if_index)")
def t4(d: Data):
    return O.resolve_ports(d.sql(REFS).withColumnRenamed("if_index", "at"), d.sql(MAC_PORTS)).select("device_id", F.col("at").alias("if_index"), "port")


LINKS = """select substr(sha1(concat(cast(a as varchar), '|', ai, '|', cast(b as varchar), '|', bi)), 1, 12) as id, a as a_device, ai as a_if, b as b_device, bi as b_if, sources, least(round(case when sides > 1 then 1.0 else 0.8 end + case when n > 1 then 0.05 else 0 end, 2), 1.0)::DOUBLE as confidence from (
 select a, ai, b, bi, string_agg(distinct source, ',' order by source) as sources, count(distinct source) as n, count(distinct device_id) as sides from (
 select device_id, source, case when device_id < remote_id then device_id else remote_id end as a, case when device_id < remote_id then local_if else remote_if end as ai, case when device_id < remote_id then remote_id else device_id end as b, case when device_id < remote_id then remote_if else local_if end as bi
 from v_neighbor_obs where device_id <> remote_id) group by 1, 2, 3, 4)"""


def _links(d: Data):
    return O.synthesise_links(d("v_neighbor_obs"))


@query("T5_links", f"select a_device, a_if, b_device, b_if, sources from ({LINKS})")
def t5(d: Data):
    return _links(d).select("a_device", "a_if", "b_device", "b_if", "sources")


@query("T6_confidence", f"select a_device, b_device, confidence from ({LINKS})")
def t6(d: Data):
    return _links(d).select("a_device", "b_device", "confidence")


@query("T7_link_ids", f"select id, a_device, b_device from ({LINKS})")
def t7(d: Data):
    return _links(d).select("id", "a_device", "b_device")


NOW = 1_700_000_000
OLD = "select id, a_device, 1000000000 + a_device as first_seen, {now} - a_device * 200000 as last_seen, a_device % 5 = 0 as manual from ({links}) where b_device % 3 <> 1"


@query("T8_carried_links", f"""
with n as (select id from ({LINKS}) where b_device % 3 <> 0), o as ({OLD.format(now=NOW, links=LINKS)})
select id, coalesce(first_seen, {NOW})::BIGINT as first_seen, (case when n.id is not null then {NOW} else last_seen end)::BIGINT as last_seen, n.id is null as stale, coalesce(manual, false) as manual
from n full join o using (id) where n.id is not null or coalesce(manual, false) or last_seen >= {NOW} - 604800""")
def t8(d: Data):
    links = _links(d)
    old = links.where("b_device % 3 <> 1").select("id", (F.col("a_device") + 1000000000).alias("first_seen"), (F.lit(NOW) - F.col("a_device") * 200000).alias("last_seen"), (F.col("a_device") % 5 == 0).alias("manual"))
    return O.carry_links(links.where("b_device % 3 <> 0"), old, NOW)


@query("T9_one_peer", f"""
with l as (select *, b_device % 7 = 0 as stale from ({LINKS})), e as (select a_device as d, a_if as i from l where not stale and confidence >= 1 union select b_device, b_if from l where not stale and confidence >= 1)
select id from l where (not stale and confidence >= 1) or not exists (select 1 from e where (d = a_device and i = a_if) or (d = b_device and i = b_if))""")
def t9(d: Data):
    return O.one_peer_per_port(_links(d).withColumn("stale", F.col("b_device") % 7 == 0)).select("id")


@query("T10_link_changes", f"select id, case when b_device % 3 = 1 then 'link_new' else 'link_lost' end as kind from ({LINKS}) where b_device % 3 in (0, 1)")
def t10(d: Data):
    links = _links(d)
    return O.link_changes(links.where("b_device % 3 <> 0"), links.where("b_device % 3 <> 1"))


@query("T11_external_nodes", f"select 'ext:' || remote_name as node, count(*) as seen from ({OBS}) where device_id % 8 = 7 group by 1")
def t11(d: Data):
    return O.external_nodes(_resolved(d))


PORTS = "select a_device, b_device, concat('GigabitEthernet1/', cast(1 + a_device % 7 as varchar(9))) as a_if, concat('Vlan', cast(1 + b_device % 7 as varchar(9))) as b_if from v_links"


@query("T12_link_load", f"""
select a_device, b_device, greatest(a.speed_mbps, b.speed_mbps) as speed_mbps, greatest(a.in_bps, b.in_bps) as util from ({PORTS}) l
left join v_interfaces a on a.device_id = a_device and a.name = a_if left join v_interfaces b on b.device_id = b_device and b.name = b_if""")
def t12(d: Data):
    return O.link_load(d.sql(PORTS), d("v_interfaces").withColumn("util", F.col("in_bps")))


@query("T13_important_ports", f"""
with l as (select l.* from ({PORTS}) l join v_devices a on a.device_id = a_device and a.role <> 'ap' join v_devices b on b.device_id = b_device and b.role <> 'ap')
select i.device_id, if_index, alias like '%uplink%' or exists (select 1 from l where (a_device = i.device_id and lower(a_if) = lower(i.name)) or (b_device = i.device_id and lower(b_if) = lower(i.name))) or regexp_matches(lower(name), '^port-channel[0-9]') as important from v_interfaces i""")
def t13(d: Data):
    return O.important_ports(d("v_interfaces").drop("important"), d.sql(PORTS), d("v_devices")).select("device_id", "if_index", "important")


@query("T14_roles", """
with v as (select * from v_links where b_device % 17 <> 3 and b_device % 13 <> 4),
p as (select distinct device_id, peer from (select a_device as device_id, b_device as peer from v union all select b_device, a_device from v)),
f as (select p.device_id, count(*) as degree, bool_or(coalesce(r.role = 'router', false)) as edge from p left join v_devices r on r.device_id = p.peer group by 1),
s as (select d.device_id, site_id, name, coalesce(degree, 0) as degree, coalesce(edge, false) as edge from v_devices d left join f using (device_id) where role in ('core', 'distribution', 'access')),
c as (select *, max(degree) over (partition by site_id) as top from s), c2 as (select *, bool_or(edge) over (partition by site_id) as any_edge from c where top >= 2 and degree >= 2 and degree >= top - 1),
core as (select device_id from (select *, row_number() over (partition by site_id order by degree desc, name) as place from c2 where edge or not any_edge) where place <= 2),
a as (select p.device_id, bool_or(k.device_id is not null) as touches, sum((k.device_id is null and s.device_id is not null)::INT) as below from p left join core k on k.device_id = p.peer left join s on s.device_id = p.peer group by 1)
select d.device_id, site_id, case when role not in ('core', 'distribution', 'access') or d.device_id % 10 = 3 then role when k.device_id is not null then 'core' when touches and below > 0 then 'distribution' else 'access' end as role
from v_devices d left join core k using (device_id) left join a using (device_id)""")
def t14(d: Data):
    links = d("v_links").withColumns({"external": F.col("b_device") % 17 == 3, "stale": F.col("b_device") % 13 == 4})
    return O.infer_roles(d("v_devices").withColumn("locked", F.col("device_id") % 10 == 3), links)


#: The links of the tree: some external, some stale; and one configured root.
TREE = """
with recursive k as (select * from v_links where not (b_device % 17 = 3) and not (b_device % 13 = 4)),
p as (select distinct device_id, peer from (select a_device as device_id, b_device as peer from k union all select b_device, a_device from k)),
e as (select device_id, count(*) as n from (select a_device as device_id from k union all select b_device from k) group by 1),
r as (select device_id from (select d.device_id, coalesce(n, 0) as n, row_number() over (partition by site_id order by case when role = 'core' then 4 when role in ('router', 'firewall') then 3 when role = 'distribution' then 2 when role = 'access' then 1 else 0 end desc, coalesce(n, 0) desc, d.device_id) as k from v_devices d left join e using (device_id)) where k = 1 and n > 0
 union select 40),
b as (select device_id, 0 as hop from r union select p.peer, hop + 1 from b join p on p.device_id = b.device_id where hop < 12),
h as (select device_id, min(hop) as hop from b group by 1),
tree as (select h.device_id, case when h.hop = 0 then null else (select min(p.device_id) from p join h u on u.device_id = p.device_id and u.hop = h.hop - 1 where p.peer = h.device_id) end as parent, h.hop from h)"""


def parent_tree(d: Data):
    links = d("v_links").withColumns({"external": F.col("b_device") % 17 == 3, "stale": F.col("b_device") % 13 == 4})
    return O.parents(d("v_devices"), links, d.spark.createDataFrame([(40,)], "device_id long"))


@query("T15_parents", TREE + " select d.device_id, parent, hop from v_devices d left join tree using (device_id)")
def t15(d: Data):
    return parent_tree(d)


@query("T16_impact", TREE + ", c as (select device_id, parent as above from tree where parent is not null union all select c.device_id, t.parent from c join tree t on t.device_id = c.above where t.parent is not null) select t.device_id, count(c.above) as below from v_devices t left join c on c.above = t.device_id group by 1")
def t16(d: Data):
    return O.impact(parent_tree(d))


_MARKED = "select *, a_device % 11 = 2 as manual, b_device % 12 = 5 as external, concat('ISP', cast(b_device % 4 as varchar(9))) as external_name from"
VIEW = f"""
with n as (select device_id, count(*) as n from v_alerts where state <> 'resolved' group by 1), s as (select device_id from v_devices where site_id = 2),
l as (select * from ({_MARKED} ({LINKS}) x) y where (confidence >= 0.9 or manual) and (a_device in (select device_id from s) or b_device in (select device_id from s)))"""


def _view(d: Data):
    marked = d.spark.sql(_MARKED.replace(" from", " from {links}"), links=_links(d).drop("external"))
    return O.view(marked, d("v_devices"), d("v_alerts"), 2, 0.9)


@query("T17_topology_view", VIEW + " select id, a_device, b_device, coalesce(x.n, 0) as a_alerts, coalesce(y.n, 0) as b_alerts from l left join n x on x.device_id = a_device left join n y on y.device_id = b_device")
def t17(d: Data):
    return _view(d)[0].select("id", "a_device", "b_device", "a_alerts", "b_alerts")


@query("T17_topology_nodes", VIEW + """ select v.device_id::VARCHAR as node, name, role, status, coalesce(n, 0) as alerts, false as external from v_devices v left join n using (device_id) where site_id = 2 union all
 select distinct 'ext:' || lower(external_name), external_name, 'other', 'unknown', 0, true from l where external""")
def t17_nodes(d: Data):
    return _view(d)[1]


@query("T18_held_neighbours", "select user_id as device_id, max(event_id) as at, max_by(event_id % 4, event_id) as n from events where event_id % 4 > 0 group by 1 having 10000 - max(event_id) <= 9990")
def t18(d: Data):
    rows = d("events").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("at"), (F.col("event_id") % 4).alias("n"))
    return O.hold_over(rows, 10000, 9990)
