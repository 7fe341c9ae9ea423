"""Queries P1 to P9, P16, P18, P20 and P27."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as O
from ..sources.storage import materialize
from .registry import Data, query
from .topology import TREE, parent_tree

RUNS = """select sample_id, device_id, ts, ok, row_number() over (partition by device_id, run order by ts, sample_id) as n from (
 select *, sum(flip) over (partition by device_id order by ts, sample_id) as run from (
 select sample_id, device_id, ts, {0} as ok, coalesce((({0}) <> lag({0}) over (partition by device_id order by ts, sample_id))::INT, 0) as flip from v_device_samples))"""


@query("P1_streaks", f"select sample_id, device_id, case when ok then 0 else n end as fails, case when ok then n else 0 end as oks from ({RUNS.format('reachable or snmp_ok')})")
def p1(d: Data):
    rows = d("v_device_samples").select("sample_id", "device_id", "ts", (F.col("reachable") | F.col("snmp_ok")).alias("ok"))
    return O.streaks(rows, "device_id", "ok", ["ts", "sample_id"]).select("sample_id", "device_id", "fails", "oks")


@query("P2_thresholds", """
with recursive s as (select sample_id, device_id, cpu_pct as v, row_number() over (partition by device_id order by ts, sample_id) as n from v_device_samples),
f as (select device_id, sample_id, n, case when v >= 30 then 1 else 0 end as run, false as on_ from s where n = 1 union all
 select s.device_id, s.sample_id, s.n, case when v >= 30 then least(run + 1, 2) when v <= 10 then 0 else run end, case when v >= 30 then on_ or least(run + 1, 2) >= 2 when v <= 10 then false else on_ end
 from f join s on s.device_id = f.device_id and s.n = f.n + 1)
select device_id, sample_id, on_ as on from f""")
def p2(d: Data):
    rows = d("v_device_samples").select("sample_id", "device_id", "ts", "cpu_pct")
    return O.thresholds(rows, "device_id", "cpu_pct", ["ts", "sample_id"], 30, 10, 2).select("device_id", "sample_id", "on")


@query("P3_silent_agents", f"select device_id, sample_id, n as run from ({RUNS.format('reachable and not snmp_ok')}) where ok and n >= 2")
def p3(d: Data):
    return O.silent_agents(d("v_device_samples"), 2)


STATUS = """
with recursive s as (select sample_id, device_id, ts, reachable as r, cpu_pct >= 50 as g, device_id % 9 = 0 and sample_id % 20 < 5 as m, device_id % 4 = 1 and sample_id % 2 = 0 as u,
 row_number() over (partition by device_id order by ts, sample_id) as n from v_device_samples),
f as (select device_id, sample_id, ts, n, case when r then 0 else 1 end as fails, case when r then 1 else 0 end as oks, case when m then 'maintenance' when not r then 'unknown' when g then 'degraded' else 'up' end as status from s where n = 1 union all
 select s.device_id, s.sample_id, s.ts, s.n, case when r then 0 else fails + 1 end, case when r then oks + 1 else 0 end,
 case when m then 'maintenance' when not r and fails + 1 >= 2 then case when u then 'unreachable' else 'down' end when not r then case when status = 'maintenance' then 'up' else status end
  when status in ('down', 'unreachable') and oks + 1 < 2 then status when g then 'degraded' else 'up' end
 from f join s on s.device_id = f.device_id and s.n = f.n + 1)"""


def polls(d: Data):
    """The polls with what their status depends on."""
    hit = lambda k, x, n: (F.col("device_id") % k == x) & (F.col("sample_id") % n[0] < n[1])
    return d("v_device_samples").select("sample_id", "device_id", "ts", "reachable", (F.col("cpu_pct") >= 50).alias("degraded"), hit(9, 0, (20, 5)).alias("maintenance"), hit(4, 1, (2, 1)).alias("upstream_down"))


#: Status by a device's own polls (g: failed is down), then by what its parent was at its last poll before.
OVER_TIME = TREE + STATUS.replace("with recursive s as", ", s as").replace("device_id % 4 = 1 and sample_id % 2 = 0 as u", "false as u").replace(", f as", ", g as").replace("\nf as (", "\ng as (").replace("from f join s on s.device_id = f.device_id and s.n = f.n + 1", "from g join s on s.device_id = g.device_id and s.n = g.n + 1").rstrip() + """,
f0 as (select g.device_id, g.sample_id, g.ts, g.status, t.parent, (select max_by(u.status, (u.ts, u.sample_id)) from g u where u.device_id = t.parent and (u.ts, u.sample_id) <= (g.ts, g.sample_id)) as upper from g left join tree t on t.device_id = g.device_id),
f as (select device_id, sample_id, ts, case when status = 'down' and upper = 'down' then 'unreachable' else status end as status, case when status = 'down' and upper = 'down' then parent end as cause from f0)"""


def _status(d: Data):
    return O.status_over_time(polls(d).drop("upstream_down"), parent_tree(d).select("device_id", "parent"), 2)


@query("P4_device_status", OVER_TIME + " select device_id, sample_id, status, cause from f")
def p4(d: Data):
    return _status(d).select("device_id", "sample_id", "status", "cause")


@query("P5_folded_over_time", OVER_TIME + """,
w as (select *, lag(status, 1, 'unknown') over (partition by device_id order by ts, sample_id) as was from f),
x as (select t.device_id, w.ts, w.sample_id, w.device_id as cause from w join tree t on t.parent = w.device_id where w.status = 'down' and w.was <> 'down')
select device_id, sample_id, cause from (select x.*, (select max_by(u.status, (u.ts, u.sample_id)) from f u where u.device_id = x.device_id and (u.ts, u.sample_id) <= (x.ts, x.sample_id)) as own from x) where own = 'down'""")
def p5_folded(d: Data):
    tree = parent_tree(d).select("device_id", "parent")
    status = materialize(O.status_over_time(polls(d).drop("upstream_down"), tree, 2).select("device_id", "ts", "sample_id", "status"))
    return O.folded_over_time(status, tree).select("device_id", "sample_id", "cause")


@query("P5_suppressed", """
with recursive p as (select device_id, cast(floor(device_id / 3) as bigint) as parent from v_devices where device_id > 0),
s as (select device_id, case when device_id % 2 = 1 or device_id % 5 = 0 then 'down' else 'up' end as status from v_devices),
c as (select device_id, device_id as cause from s where status = 'down' union all
 select c.device_id, p.parent from c join p on p.device_id = c.cause join s on s.device_id = p.parent and s.status = 'down'),
t as (select device_id, min(cause) as cause from c group by device_id)
select s.device_id, case when t.cause <> s.device_id then 'unreachable' else status end as status, case when t.cause <> s.device_id then t.cause end as cause from s left join t using (device_id)""")
def p5(d: Data):
    devices = d("v_devices")
    parents = devices.where("device_id > 0").select("device_id", F.floor(F.col("device_id") / 3).cast("long").alias("parent"))
    status = devices.select("device_id", F.when((F.col("device_id") % 2 == 1) | (F.col("device_id") % 5 == 0), "down").otherwise("up").alias("status"))
    return O.suppressed(status, parents)


MOVES = "select device_id, sample_id, ts, epoch_us(ts) as us, status, previous from (select *, lag(status) over (partition by device_id order by ts, sample_id) as previous from f where status <> 'unknown') where previous <> status"


@query("P6_flaps", OVER_TIME + f", m as ({MOVES}) select device_id, sample_id, previous, status, count(*) over w as changes, (count(*) over w) > 3 as flapping from m window w as (partition by device_id order by us range between 863999999999 preceding and current row)")
def p6(d: Data):
    return O.transitions(_status(d), "device_id", ["ts", "sample_id"], 864000, 3).select("device_id", "sample_id", "previous", "status", "changes", "flapping")


@query("P7_interface_status", """
select i.device_id, if_index, case when d.s in ('down', 'unreachable') or d.s is distinct from 'maintenance' and not admin_up then 'unknown' when d.s = 'maintenance' then 'maintenance' when oper_up then 'up' else 'down' end as status
from v_interfaces i left join (select device_id, case when device_id % 9 = 4 then 'maintenance' else status end as s from v_devices where monitored) d using (device_id)""")
def p7(d: Data):
    devices = d("v_devices").where("monitored").withColumn("status", F.when(F.col("device_id") % 9 == 4, "maintenance").otherwise(F.col("status")))
    return O.interface_status(d("v_interfaces"), devices).select("device_id", "if_index", "status")


#: Samples of four ports a device, link events, and the device's own status, for the merge of all three.
MERGED = """
with d as (select user_id as device_id, ts, event_id as seq, case event_id % 9 when 0 then 'down' when 1 then 'unreachable' when 2 then 'maintenance' else 'up' end as status from events where event_id % 5 = 2),
i as (select user_id as device_id, event_id % 3 as if_index, ts, event_id as seq, 1 as kind, event_id % 11 <> 0 as admin_up, event_id % 7 <> 1 as up, case when event_id % 4 > 0 then value % 100 end as util, case when event_id % 4 > 0 then event_id % 13 * 0.2 end as err, event_id % 3 < 2 as important from events
 union all select user_id, event_id % 3, ts, event_id, 2, null, event_id % 2 = 0, null, null, null from events where event_type in ('error', 'signup')),
m as (select i.*, (select max_by(status, (d.ts, d.seq)) from d where d.device_id = i.device_id and d.ts <= i.ts) as device from i),
b as (select *, case when kind = 2 then case when up then 'up' else 'down' end when device in ('down', 'unreachable') then 'unknown' when device = 'maintenance' then 'maintenance' when not admin_up then 'unknown' when up then 'up' else 'down' end as base,
 row_number() over (partition by device_id, if_index order by ts, kind, seq) as n from m),
v as (select *, case when kind = 1 and base = 'up' and important then util end as u, case when kind = 1 and base = 'up' and important then err end as e from b),
f as (select device_id, if_index, 0::BIGINT as n, 0 as ru, false as ou, 0 as re, false as oe from (select distinct device_id, if_index from v) union all
 select v.device_id, v.if_index, v.n, case when u >= 60 then ru + 1 when u <= 30 then 0 else ru end, case when u >= 60 then ou or ru + 1 >= 2 when u <= 30 then false else ou end,
  case when e >= 1 then re + 1 when e <= 0.3 then 0 else re end, case when e >= 1 then oe or re + 1 >= 2 when e <= 0.3 then false else oe end
 from f join v on v.device_id = f.device_id and v.if_index = f.if_index and v.n = f.n + 1)
select v.device_id, v.if_index, v.seq, case kind when 1 then 'sample' else 'event' end as kind, case when (u is not null and ou) or (e is not null and oe) then 'degraded' else base end as status from v join f on v.device_id = f.device_id and v.if_index = f.if_index and v.n = f.n"""


@query("P8_interface_timeline", MERGED.replace("\nwith d as", "\nwith recursive d as"))
def p8_timeline(d: Data):
    e = d("events").withColumns({"device_id": F.col("user_id"), "seq": F.col("event_id"), "if_index": F.col("event_id") % 3})
    n = F.col("event_id")
    rates = n % 4 > 0
    samples = e.select("device_id", "if_index", "ts", "seq", (n % 11 != 0).alias("admin_up"), (n % 7 != 1).alias("oper_up"), F.when(rates, F.col("value") % 100).alias("util"), F.when(rates, n % 13 * 0.2).alias("err_rate"), (n % 3 < 2).alias("important"))
    links = e.where("event_type in ('error', 'signup')").select("device_id", "if_index", "ts", "seq", (n % 2 == 0).alias("up"))
    devices = e.where(n % 5 == 2).select("device_id", "ts", "seq", F.when(n % 9 == 0, "down").when(n % 9 == 1, "unreachable").when(n % 9 == 2, "maintenance").otherwise("up").alias("status"))
    made = O.interface_timeline(samples, links, devices, (60, 30, 2), (1.0, 0.3, 2))
    return made.select("device_id", "if_index", "seq", "kind", "status")


@query("P8_hard_evidence", """
with r as (select device_id as object, ts, reachable as up, 0 as kind from v_device_samples union all select device_id, recv, kind2 = 1, 1 from (select *, trap_id % 7 as kind2 from v_traps) where kind2 <= 1)
select object, max_by(up, (ts, kind, up)) as up, max(ts) as since from r group by object""")
def p8(d: Data):
    samples = d("v_device_samples").select(F.col("device_id").alias("object"), "ts", F.col("reachable").alias("up"))
    events = d("v_traps").where("trap_id % 7 <= 1").select(F.col("device_id").alias("object"), F.col("recv").alias("ts"), (F.col("trap_id") % 7 == 1).alias("up"))
    return O.latest_evidence(samples, events)


@query("P9_failure_bursts", """
select event_id, user_id, recent from (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 172799999999 preceding and current row) as recent from events where event_type = 'error') where recent >= 3""")
def p9(d: Data):
    return O.sliding_count(d("events").where("event_type = 'error'"), "user_id", 172800, 3).select("event_id", "user_id", "recent")


@query("P16_sites_down", "select site_id, count(*) as devices, sum((status in ('down', 'unreachable'))::INT)::BIGINT as bad from v_devices where monitored group by 1 having count(*) >= 2 and sum((status in ('down', 'unreachable'))::INT) * 100 >= count(*) * 15")
def p16(d: Data):
    return O.sites_down(d("v_devices"), 2, 15)


NOW = 1706659200


@query("P18_stale_devices", f"select device_id, max(floor(epoch(ts)))::BIGINT as last_poll, 'unknown' as status from v_device_samples where device_id in (select device_id from v_devices where monitored and not (device_id % 10 = 5)) group by 1 having {NOW} - last_poll > 5 * 7200")
def p18(d: Data):
    devices = d("v_devices").withColumn("status", F.when(F.col("device_id") % 10 == 5, "unknown").otherwise(F.col("status")))
    return O.stale_devices(d("v_device_samples"), devices, NOW, 7200)


@query("P20_maintenance", """
select sample_id, device_id from v_device_samples s where exists (select 1 from v_maintenance w where s.ts between w.from_ts and w.to_ts
 and (w.device_id = s.device_id or (w.device_id is null and w.site_id = s.device_id % 5) or (w.device_id is null and w.site_id is null)))""")
def p20(d: Data):
    rows = d("v_device_samples").select("sample_id", "device_id", (F.col("device_id") % 5).alias("site_id"), "ts")
    return O.under_maintenance(rows, d("v_maintenance")).select("sample_id", "device_id")


@query("P27_status_events", OVER_TIME + f", m as ({MOVES}) select device_id, sample_id, previous, status, case status when 'down' then 'major' when 'degraded' then 'minor' else 'info' end as severity from m")
def p27(d: Data):
    severity = F.when(F.col("status") == "down", "major").when(F.col("status") == "degraded", "minor").otherwise("info")
    return O.transitions(_status(d), "device_id", ["ts", "sample_id"]).select("device_id", "sample_id", "previous", "status", severity.alias("severity"))
