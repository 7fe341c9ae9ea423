"""Queries E1 to E13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import canonical_mac, is_multicast
from ..operators import endpoints as O
from .registry import Data, query

RAW = "select l_orderkey as id, l_linenumber as n, case l_linenumber % 4 when 0 then concat('00:1A:2B:3C:4D:', substr(lpad(hex(l_partkey), 12, '0'), 11, 2)) when 1 then concat('001a.2b3c.4d', substr(lpad(hex(l_partkey), 12, '0'), 11, 2)) when 2 then concat('00-1a-2b-3c-4d-', substr(lpad(hex(l_partkey), 12, '0'), 11, 1)) else 'zz' end as mac from lineitem"


@query("E1_canonical_macs", f"select id, n, case when n % 4 in (0, 1) then '00:1a:2b:3c:4d:' || lower(mac[-2:]) else '' end as mac from ({RAW})")
def e1(d: Data):
    return d.sql(RAW).select("id", "n", canonical_mac(F.col("mac")).alias("mac"))


@query("E2_multicast", "select mac, count(*) as n from v_fdb where mac[2] in ('1', '3', '5', '7', '9', 'b', 'd', 'f') or mac[12] in ('1', '3') group by 1")
def e2(d: Data):
    turned = F.concat(F.lit("0"), F.substring("mac", 12, 1))
    return d("v_fdb").where(is_multicast(F.col("mac")) | (is_multicast(turned) & F.substring("mac", 12, 1).isin("1", "3"))).groupBy("mac").agg(F.count("*").alias("n"))


CHASSIS = "select device_id, lower(lpad(hex(device_id * 20), 12, '0')) as mac from v_devices"
UPLINKS = f"""select device_id, if_index from v_interfaces where if_index = 1 union select a_device, 2 from v_links union
 select f.device_id, f.if_index from v_fdb f join ({CHASSIS}) c using (mac) where c.device_id <> f.device_id"""


def _uplinks(d: Data):
    ends = d("v_interfaces").where("if_index = 1").select("device_id", "if_index")
    peers = d("v_links").select(F.col("a_device").alias("device_id"), F.lit(2).cast("long").alias("if_index"))
    return O.uplink_ports(d("v_fdb"), ends, peers, d.sql(CHASSIS))


@query("E3_uplinks", f"select device_id, if_index::BIGINT as if_index from ({UPLINKS})")
def e3(d: Data):
    return _uplinks(d).select("device_id", F.col("if_index").cast("long").alias("if_index"))


@query("E4_port_load", "select device_id, if_index, count(distinct mac) as load from v_fdb group by 1, 2")
def e4(d: Data):
    return O.port_load(d("v_fdb"))


PLACED = f"""
with l as (select device_id, if_index, count(distinct mac) as load from v_fdb group by 1, 2),
s as (select mac, f.device_id, f.if_index, max(ts) as ts from v_fdb f where mac[2] not in ('1', '3', '5', '7', '9', 'b', 'd', 'f') and not exists (select 1 from ({UPLINKS}) u where u.device_id = f.device_id and u.if_index = f.if_index) group by 1, 2, 3),
b as (select *, row_number() over (partition by mac, device_id order by load, ts desc, if_index) as n from s join l using (device_id, if_index)),
placed as (select mac, device_id, if_index, ts, load from (select *, row_number() over (partition by mac order by load, ts desc, device_id, if_index) as k from b where n = 1) where k = 1)"""


def _placed(d: Data):
    return O.place(d("v_fdb"), _uplinks(d))


@query("E5_placed", PLACED + " select * from placed")
def e5(d: Data):
    return _placed(d)


_BEFORE = "select mac, device_id, case when load % 2 = 0 then 9 else if_index end as if_index, ts - interval '1' hour * cast(load % 40 as int) as ts from placed"


@query("E6_moves", PLACED + f""", o as ({_BEFORE})
select p.mac, p.device_id, p.if_index, o.device_id as from_device, o.if_index as from_if from placed p join o on o.mac = p.mac where p.if_index <> o.if_index and p.load % 40 < 24""")
def e6(d: Data):
    now = _placed(d)
    before = d.spark.sql(_BEFORE.replace("placed", "{placed}"), placed=now)
    return O.moves(now, before, now).select("mac", "device_id", "if_index", "from_device", "from_if")


ARP = "select mac, string_agg(ip, ',' order by ts desc, ip) as ips, max(ts) as seen from (select *, row_number() over (partition by mac order by ts desc, ip) as n from (select mac, ip, max(ts) as ts from v_arp where mac[2] not in ('1', '3', '5', '7', '9', 'b', 'd', 'f') group by 1, 2)) where n <= 4 group by 1"


@query("E7_arp", ARP)
def e7(d: Data):
    return O.arp_merge(d("v_arp"))


VENDORS = [("000000000", "Nine"), ("0000000", "Seven"), ("000000", "Six")]
MACS = "select distinct concat(case when l_partkey % 5 = 0 then '000000001' when l_partkey % 5 = 1 then '000000000' when l_partkey % 5 = 2 then '000000f00' when l_partkey % 5 = 3 then '020000000' else '100000000' end, substr(lower(lpad(hex(l_partkey), 12, '0')), 10, 3)) as mac from lineitem"


@query("E8_vendors", f"select mac, case when mac[:9] = '000000000' then 'Nine' when mac[:7] = '0000000' then 'Seven' when mac[:6] = '000000' then 'Six' when mac[2] in ('2', '3', '6', '7', 'a', 'b', 'e', 'f') then 'locally administered' else '' end as vendor from ({MACS})")
def e8(d: Data):
    return O.vendor_of(d.sql(MACS), d.spark.createDataFrame(VENDORS, "prefix string, vendor string"))


_KNOWN = f"""select mac, ips, seen, device_id, if_index, arp_device, 'Vendor' || right(mac, 1) as vendor, 'Gi0/' || cast(if_index as varchar(9)) as if_name from ({{placed}}) p full join ({{arp}}) a using (mac)
 left join (select mac, max(device_id) as arp_device from v_arp group by mac) x using (mac)"""
_SCOPES = [("ip", "starts_with(i, '10.2.1.')", "10.2.1.", None, None), ("mac", "contains(mac, '00009')", "00:00:9", None, None), ("port", "contains(lower(if_name), 'gi0/4')", "GI0/4", None, None), ("vendor", "lower(vendor) = 'vendora'", "vendorA", None, None), ("device", "device_id = 5 or arp_device = 5", "", 5, None), ("on_port", "device_id = 5 and if_index = 3", "", 5, 3)]


@query("E9_search", PLACED + f", k as ({_KNOWN.format(placed='select * from placed', arp=ARP)}) " + " union all ".join(
    f"(select '{n}' as part, mac, seen from k where {'exists (select 1 from (select unnest(string_split(ips, chr(44))) as i) where ' + w + ')' if n == 'ip' else w} order by seen desc nulls last, mac limit 200)" for n, w, *_ in _SCOPES))
def e9(d: Data):
    seen_by = d("v_arp").groupBy("mac").agg(F.max("device_id").alias("arp_device"))
    rows = _placed(d).select("mac", "device_id", "if_index").join(O.arp_merge(d("v_arp")), "mac", "full_outer").join(seen_by, "mac", "left")
    rows = rows.withColumns({"vendor": F.concat(F.lit("Vendor"), F.right("mac", F.lit(1))), "if_name": F.concat(F.lit("Gi0/"), F.col("if_index").cast("string"))})
    out = [O.search(rows, text, device, port).select(F.lit(n).alias("part"), "mac", "seen") for n, _, text, device, port in _SCOPES]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), out)


@query("E10_per_port", PLACED + " select device_id, if_index, count(*) as endpoints from placed group by 1, 2")
def e10(d: Data):
    return O.per_port(_placed(d))


@query("E11_statistics", PLACED + f" select count(*) as endpoints, count(p.device_id) as placed, count(a.ips) as with_ip from placed p full join ({ARP}) a using (mac)")
def e11(d: Data):
    return O.statistics(_placed(d).join(O.arp_merge(d("v_arp")), "mac", "full_outer"))


@query("E12_newest", PLACED + " select mac, ts from placed order by ts desc, mac limit 100")
def e12(d: Data):
    return O.newest(_placed(d), 100).select("mac", "ts")


@query("E13_forgotten", PLACED + " select mac, case when device_id % 4 <> 0 then device_id end as device_id, case when device_id % 4 <> 0 then if_index end as if_index from placed")
def e13(d: Data):
    return O.forget(_placed(d), d("v_devices").where("device_id % 4 = 0"))
