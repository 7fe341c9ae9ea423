"""Queries N1 to N13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as O
from .registry import Data, query

#: All walks: those with rows, and for some devices a last one that found nothing.
WALKS = "select distinct device_id, snapshot from v_peer_snapshots union select device_id, max(snapshot) + 1 from v_peer_snapshots where device_id % 3 = 0 group by device_id"
CHANGES = f"""
with s as (select device_id, snapshot, lag(snapshot) over (partition by device_id order by snapshot) as previous from ({WALKS})),
n as (select v.* from v_peer_snapshots v join s using (device_id, snapshot) where s.previous is not null),
o as (select s.device_id, s.snapshot, v.peer, v.up, v.prefixes from s join v_peer_snapshots v on v.device_id = s.device_id and v.snapshot = s.previous),
c as (select coalesce(n.device_id, o.device_id) as device_id, coalesce(n.snapshot, o.snapshot) as snapshot, coalesce(n.peer, o.peer) as peer,
 case when n.up is null and o.up then 'vanished' when o.up and not n.up then 'lost' when not o.up and n.up then 'regained' when o.up and n.up and n.prefixes * 4 < o.prefixes then 'prefixes_dropped' end as kind
 from n full join o on n.device_id = o.device_id and n.snapshot = o.snapshot and n.peer = o.peer)"""


@query("N1_peer_changes", CHANGES + " select device_id, snapshot, peer, kind from c where kind is not null")
def n1(d: Data):
    return O.peer_changes(d("v_peer_snapshots"), d.sql(WALKS))


@query("N2_adjacency_changes", CHANGES + """ select device_id, snapshot, peer, kind from c where kind in ('lost', 'vanished') union all
select device_id, snapshot, null, 'recovered' from (
 select coalesce(n.device_id, o.device_id) as device_id, coalesce(n.snapshot, o.snapshot) as snapshot, sum((o.up and (n.up is null or not n.up))::INT) as lost, sum((not o.up and n.up)::INT) as back, sum((not n.up)::INT) as bad
 from n full join o on n.device_id = o.device_id and n.snapshot = o.snapshot and n.peer = o.peer group by 1, 2) where coalesce(lost, 0) = 0 and back > 0 and coalesce(bad, 0) = 0""")
def n2(d: Data):
    return O.adjacency_changes(d("v_peer_snapshots"), d.sql(WALKS))


STP = "select device_id, snapshot, max(peer) % 7 as root, sum(prefixes) as changes from v_peer_snapshots group by device_id, snapshot"


@query("N3_spanning_tree_changes", f"""
select device_id, snapshot, case when root <> r then 'root_changed' else 'topology_change' end as kind, case when root = r then (changes - n)::BIGINT end as delta
from (select *, lag(root) over w as r, lag(changes) over w as n from ({STP}) window w as (partition by device_id order by snapshot)) where r is not null and (root <> r or changes > n)""")
def n3(d: Data):
    return O.spanning_tree_changes(d.sql(STP))


BUNDLES = "select device_id, peer % 4 as bundle, snapshot, sum(case when up then 1 else 0 end) as up, count(*) as members from v_peer_snapshots group by device_id, peer % 4, snapshot"


@query("N4_bundle_changes", f"""
with s as (select device_id, snapshot, lag(snapshot) over (partition by device_id order by snapshot) as previous from ({WALKS})), b as ({BUNDLES})
select device_id, bundle, snapshot, case when up < w then 'member_down' else 'complete' end as kind from (
 select b.*, o.up as w from b join s using (device_id, snapshot) join b o on o.device_id = b.device_id and o.bundle = b.bundle and o.snapshot = s.previous) where up < w or (up > w and up = members)""")
def n4(d: Data):
    return O.bundle_changes(d.sql(BUNDLES), d.sql(WALKS))


PATHS = "select user_id as device_id, event_id % 3 as path, event_id as at, event_type <> 'error' as up, value % 10 as loss, value * 2 as latency from events"


@query("N5_path_changes", f"""select device_id, path, "at", case when w and not up then 'down' when not w and up then 'up' else 'degraded' end as kind from (
 select *, coalesce(lag(up) over (partition by device_id, path order by "at"), true) as w from ({PATHS})) where (w and not up) or (not w and up) or (up and (loss >= 5 or latency >= 250))""")
def n5(d: Data):
    return O.path_changes(d.sql(PATHS))


@query("N6_controller_members", """
select coalesce(f.id, k.id) as id, coalesce(f.status, 'down') as status, k.id is null as is_new, f.id is null as missing
from (select device_id as id, status from v_devices where device_id % 3 <> 0) f full join (select device_id as id from v_devices where device_id % 4 <> 1) k on f.id = k.id""")
def n6(d: Data):
    devices = d("v_devices")
    return O.merge_inventory(devices.where("device_id % 3 <> 0").select(F.col("device_id").alias("id"), "status"), devices.where("device_id % 4 <> 1").select(F.col("device_id").alias("id")))


@query("N6_member_samples", """
select coalesce(f.id, k.id) as device_id, 99 as ts, coalesce(up, false) as reachable, coalesce(up, false) as snmp_ok, case when f.id is null then 'no longer listed by controller wlc' when not up then 'controller wlc reports the access point down' end as error
from (select device_id as id, status <> 'down' as up from v_devices where device_id % 3 <> 0) f full join (select device_id as id, monitored from v_devices where device_id % 4 <> 1) k on f.id = k.id where coalesce(monitored, true)""")
def n6_samples(d: Data):
    devices = d("v_devices").withColumnRenamed("device_id", "id").withColumn("up", F.col("status") != "down")
    return O.member_samples(devices.where("id % 3 <> 0"), devices.where("id % 4 <> 1"), "wlc", 99)


@query("N7_wireless_overview", "select site_id, count(*) as points, sum(n)::BIGINT as clients from v_devices d join (select device_id, count(distinct mac) as n from v_fdb group by 1) f using (device_id) where role in ('ap', 'access') group by 1")
def n7(d: Data):
    points = d("v_devices").where("role in ('ap', 'access')").join(d("v_fdb").groupBy("device_id").agg(F.countDistinct("mac").alias("n")), "device_id")
    return points.groupBy("site_id").agg(F.count("*").alias("points"), F.sum("n").alias("clients"))


@query("N8_wan_overview", f'select device_id, path, up, loss, latency from (select *, row_number() over (partition by device_id, path order by "at" desc) as n from ({PATHS})) where n = 1')
def n8(d: Data):
    last = d.sql(PATHS).groupBy("device_id", "path").agg(F.max_by(F.struct("up", "loss", "latency"), "at").alias("x"))
    return last.select("device_id", "path", "x.*").orderBy("up", "device_id", "path")


@query("N9_wireless_clients", """
with p as (select device_id as ap, case when device_id % 2 = 0 then 0 else device_id + 5 end as radio from v_devices),
e as (select ap, 'ssid' || (vlan % 3)::VARCHAR as ssid, radio, count(*) as clients from v_fdb f join p on p.ap = f.device_id group by 1, 2, 3)
select ap, ssid, clients, coalesce(nullif(radio, 0), sum(clients) over (partition by ap))::BIGINT as ap_clients from e""")
def n9(d: Data):
    stations = d("v_fdb").select(F.col("device_id").alias("mac"), F.concat(F.lit("ssid"), (F.col("vlan") % 3).cast("string")).alias("ssid"))
    points = d("v_devices").select(F.col("device_id").alias("mac"), F.col("device_id").alias("ap"), F.when(F.col("device_id") % 2 == 0, 0).otherwise(F.col("device_id") + 5).alias("radio_clients"))
    return O.clients(stations, points)


MAPS = "select distinct l_suppkey as device_id, cast(l_orderkey % 16 as int) as vlan, case l_orderkey % 16 when 0 then 'A0' when 1 then '0F' when 2 then 'ff' when 3 then '00' else concat(cast(l_orderkey % 16 % 8 as varchar(2)), '8') end as ports from lineitem"


@query("N10_vlan_members", f"""
select m.device_id, vlan, string_agg(name, ',' order by i.if_index) as members, count(*) as n from ({MAPS}) m join v_interfaces i on i.device_id = m.device_id
where (('0x' || ports)::INT >> (8 - i.if_index::INT)) & 1 = 1 group by 1, 2""")
def n10(d: Data):
    return O.bitmap_members(d.sql(MAPS), d("v_interfaces"))


STATES = "select device_id, if_index as port, case when if_index = 3 and device_id % 4 > 0 then 'root' else 'designated' end as role, case when oper_up then 'forwarding' else 'blocking' end as state from v_interfaces"


@query("N11_spanning_tree", f"""select device_id, sum((role = 'root')::INT) = 0 as is_root, sum((state = 'forwarding')::INT)::BIGINT as forwarding, sum((state = 'blocking')::INT)::BIGINT as blocking,
 coalesce(string_agg(case when state = 'blocking' then port::VARCHAR end, ',' order by port), '') as blocked from ({STATES}) group by 1""")
def n11(d: Data):
    return O.spanning_tree_summary(d.sql(STATES))


@query("N12_bundles", "select device_id, 1 + if_index % 2 as bundle, count(*) as members, sum(oper_up::INT)::BIGINT as up from v_interfaces where 1 + if_index % 2 <> if_index group by 1, 2")
def n12(d: Data):
    ports = d("v_interfaces")
    return O.bundles(ports.select("device_id", "if_index", (1 + F.col("if_index") % 2).alias("bundle")), ports)


WALK = """select device_id, peer as idx, 'state' as "column", cast(1 + max(peer) % 6 as varchar(9)) as value from v_peer_snapshots group by device_id, peer union all
select device_id, peer, 'remote_as', cast(65000 + peer as varchar(9)) from v_peer_snapshots group by device_id, peer"""


@query("N13_peer_table", """
select device_id, peer as idx, case 1 + peer % 6 when 1 then 'idle' when 2 then 'connect' when 3 then 'active' when 4 then 'opensent' when 5 then 'openconfirm' else 'established' end as state, 65000 + peer as remote_as, sum(prefixes)::BIGINT as prefixes
from v_peer_snapshots group by 1, 2""")
def n13(d: Data):
    walk = d.sql(WALK.replace('"column"', "`column`"))
    return O.peer_table(walk, d("v_peer_snapshots").select("device_id", F.col("peer").alias("idx"), F.col("prefixes").alias("accepted")))
