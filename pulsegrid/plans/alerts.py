"""Queries P10 to P15, P17, P19 and P21 to P26."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import alerts as O
from .registry import Data, query

NOW = 1705968000  # 2024-01-23
EVENT_RULES = "(values " + ", ".join(f"('{r[0]}', '{r[6]}', {r[5]})" for r in O.RULES if r[1] == "event") + ") r(kind, severity, cycles)"
KINDS = "select event_id as id, user_id as device_id, ts, case event_id % 6 when 0 then 'bgp_neighbor_down' when 1 then 'config_changed' when 2 then 'endpoint_moved' when 3 then 'log_flood' when 4 then 'bgp_neighbor_up' else 'nothing' end as kind, concat(event_type, ' ', repeat(props, 12)) as message, case when event_id % 2 = 0 then concat('bgp:', cast(user_id as varchar(20))) end as dedup_key from events"


@query("P10_event_alerts", f"select id, e.kind, device_id, severity, case when length(message) > 120 then message[1:120] || '…' else message end as title, coalesce(dedup_key, e.kind || ':' || device_id::VARCHAR) as dedup_key from ({KINDS}) e join {EVENT_RULES} on r.kind = e.kind where severity <> 'info'")
def p10(d: Data):
    return O.alerts_from_events(d.sql(KINDS), O.rule_table(d.spark)).select("id", "kind", "device_id", "severity", "title", "dedup_key")


@query("P11_clearing_events", f"select 'bgp:' || device_id::VARCHAR as dedup_key, count(*) as n, max(ts) as ts from ({KINDS}) where kind = 'bgp_neighbor_up' group by 1")
def p11(d: Data):
    return O.clearing_keys(d.sql(KINDS)).groupBy("dedup_key").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))


ACTIONS = """select concat('k', cast(user_id % 60 as varchar(9))) as dedup_key, event_id as n, cast(event_id * 337 as double) as t,
 case when event_id % 3 = 0 then 'resolve' when event_id % 11 = 1 then 'notified' else 'raise' end as action, cast(event_id % 4 + 1 as int) as severity, case when event_id % 5 = 2 then 'trap, v2' else event_type end as source,
 case when event_id % 7 = 5 then concat('r', cast(event_id % 4 as varchar(9))) end as root_cause, concat('title ', cast(event_id % 9 as varchar(9))) as title, concat('detail ', cast(event_id % 8 as varchar(9))) as detail,
 case when event_id % 5 > 1 then concat(cast(event_id % 5 as varchar(9)), ' downstream') else '' end as impact from events"""
#: The same with what operators do to some of the alerts.
BOTH = ACTIONS.replace("case when event_id % 3 = 0 then 'resolve'", "case when event_id % 13 = 5 then 'ack' when event_id % 17 = 3 then 'manual' when event_id % 3 = 0 then 'resolve'")
_HMS = "lpad((t::BIGINT // 3600 % 24)::VARCHAR, 2, '0') || ':' || lpad((t::BIGINT // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t::BIGINT % 60)::VARCHAR, 2, '0')"


def folded(actions: str) -> str:
    """The alert after each action, by recursion over the actions of a key."""
    return f"""
with recursive s as (select *, source || ' ' || {_HMS} as mark, row_number() over (partition by dedup_key order by t, n) as i from ({actions})),
f as (select dedup_key, 0::BIGINT as i, 0 as k, null::VARCHAR as st, null::DOUBLE as opened, null::DOUBLE as updated, null::DOUBLE as resolved, 0 as occ, 0 as sev, 0 as re, null::VARCHAR as root, false as told,
  null::VARCHAR as ti, null::VARCHAR as de, null::VARCHAR as im, []::VARCHAR[] as ev from (select distinct dedup_key from s) union all
 select dedup_key, i, k + fresh::INT, case when fresh or again then 'open' when ends or hand then 'resolved' when action = 'ack' and k > 0 and st = 'open' then 'acked' else st end,
  case when fresh then t else opened end, case when fresh or again or more or ends or hand or (action = 'ack' and k > 0) then t else updated end,
  case when fresh or again then null when ends or hand then t else resolved end, case when fresh then 1 when again or more then occ + 1 else occ end,
  case when fresh or (more and folds) then severity when more then greatest(sev, severity) else sev end, case when fresh then 0 when again then re + 1 else re end,
  case when fresh or (more and folds) then root_cause else root end, case when fresh or again then false when action = 'notified' and k > 0 then true else told end,
  case when fresh or (more and folds) then title else ti end, case when fresh or (more and folds) then detail else de end, case when fresh then impact when more and impact <> '' then impact else im end,
  case when fresh then [mark] when again then list_append(ev, mark || ' (re-opened)') when hand then list_append(ev, 'resolved manually by ' || mark) when more and len(ev) < 20 then list_append(ev, mark) when ends and len(ev) < 20 then list_append(ev, 'resolved: ' || mark) else ev end
 from (select *, action = 'raise' and (k = 0 or (resolved is not null and t - resolved >= 30000)) as fresh, action = 'raise' and k > 0 and resolved is not null and t - resolved < 30000 as again,
   action = 'raise' and k > 0 and resolved is null as more, action = 'resolve' and k > 0 and resolved is null as ends, action = 'manual' and k > 0 as hand, root_cause is not null and root_cause is distinct from root as folds
   from (select s.*, f.k, f.st, f.opened, f.updated, f.resolved, f.occ, f.sev, f.re, f.root, f.told, f.ti, f.de, f.im, f.ev from f join s on s.dedup_key = f.dedup_key and s.i = f.i + 1)))
select dedup_key, k::INT as n, st as state, opened, updated, resolved, occ::INT as occurrences, sev::INT as severity, re::INT as reopened, root as root_cause, told as notified, ti as title, de as detail, im as impact, array_to_string(ev, ', ') as evidence
from (select *, row_number() over (partition by dedup_key, k order by i desc) as last from f where k > 0) where last = 1"""


FOLDED = folded(ACTIONS)


@query("P12_upserted_alerts", FOLDED)
def p12(d: Data):
    return O.upsert_alerts(d.sql(ACTIONS), 30000).withColumn("evidence", F.array_join("evidence", ", "))


@query("P23_acted_alerts", folded(BOTH))
def p23_acted(d: Data):
    return O.upsert_alerts(d.sql(BOTH), 30000).withColumn("evidence", F.array_join("evidence", ", "))


@query("P13_resolved_alerts", f"select dedup_key, n, resolved, resolved - opened as seconds from ({FOLDED}) where resolved is not null")
def p13(d: Data):
    return O.upsert_alerts(d.sql(ACTIONS), 30000).where("resolved is not null").select("dedup_key", "n", "resolved", (F.col("resolved") - F.col("opened")).alias("seconds"))


VALUED = "select a.id, a.rule, a.severity, d.role, cast(a.id % 120 as double) as value, 95.0e0 as escalate from v_alerts a join v_devices d on d.device_id = a.device_id"


@query("P14_severity_by_role", f"select id, role, case when rule = 'device_down' and role in ('core', 'router', 'firewall') then 'critical' when value >= 95 then 'major' else severity end as severity from ({VALUED})")
def p14(d: Data):
    return O.severity_by_role(d.sql(VALUED)).select("id", "role", "severity")


@query("P15_folded_children", "select a.id, coalesce(c.n, 0) as children from v_alerts a left join (select root_cause, count(*) as n from v_alerts group by 1) c on c.root_cause = a.id where a.root_cause is null")
def p15(d: Data):
    return O.fold_children(d("v_alerts")).select("id", "children")


_ENDING = "select case id % 4 when 0 then 'config_changed' when 1 then 'environment_fault' else rule end as rule, id, state, device_id, root_cause, opened_at + interval '1' minute * cast(occurrences as int) as updated_at from v_alerts"


@query("P17_auto_resolved", f"""
with a as ({_ENDING}), t as (select id, a.rule from a join {EVENT_RULES} on r.kind = a.rule where state <> 'resolved' and cycles > 0 and {NOW} - floor(epoch(updated_at)) > cycles * 60)
select id, rule, 'timed' as reason from t union all
select a.id, a.rule, 'root' from a join v_devices d on d.device_id = a.device_id and d.status = 'up' where state <> 'resolved' and root_cause is not null
 and not exists (select 1 from a b where b.id = a.root_cause and b.state <> 'resolved') and a.id not in (select id from t)""")
def p17(d: Data):
    return O.auto_resolved(d.sql(_ENDING), O.rule_table(d.spark), d("v_devices"), NOW)


#: Alerts of families over time: a root (id of the family) and two children, one of which has a limit of its own, and the state of the children's devices.
LIVES = """select user_id as family, cast(event_id * 300 + 300 as double) as t, event_id as n, user_id * 10 + case when event_id % 5 < 2 then 0 else event_id % 5 - 1 end as id0,
 case when event_id % 5 = 4 then 'up' when event_id % 5 = 3 and event_id % 4 = 0 then 'down' else 'raise' end as kind0 from events"""
FAMILIES = f"""select family * 10 as family, t, n, case when kind0 = 'raise' then id0 else family * 10 + 1 + n % 2 end as id, kind0 as kind,
 case when kind0 = 'raise' then case (case when kind0 = 'raise' then id0 else 0 end) % 10 when 0 then 40000.5e0 when 1 then 70000.5e0 end end as lasts from ({LIVES})"""
ENDS = f"""
with recursive x as ({FAMILIES}), top as (select max(t) as top from x), s as (select *, row_number() over (partition by family order by t, n) as i, lead(t, 1, (select top from top)) over (partition by family order by t, n) as next from x),
f as (select family, 0::BIGINT as i, [null, null, null]::DOUBLE[] as o, [null, null, null]::DOUBLE[] as u, [null, null, null]::DOUBLE[] as r, [0, 0, 0] as c, [false, false, false] as up, []::STRUCT(k INT, o DOUBLE, t DOUBLE, w VARCHAR, c INT)[] as e from (select distinct family from s) union all
 select family, i, o, u, [case when e0 then d0 else r0 end, coalesce(case when t1 <= coalesce(f1, 1e18) then t1 else f1 end, r[2]), coalesce(f2, r[3])], c, up,
  list_concat(case when e0 then [{{'k': 0, 'o': o[1], 't': d0, 'w': 'timed', 'c': c[1]}}] else [] end, list_concat(
   case when t1 <= coalesce(f1, 1e18) then [{{'k': 1, 'o': o[2], 't': t1, 'w': 'timed', 'c': c[2]}}] when f1 is not null then [{{'k': 1, 'o': o[2], 't': f1, 'w': 'root', 'c': c[2]}}] else [] end, case when f2 is not null then [{{'k': 2, 'o': o[3], 't': f2, 'w': 'root', 'c': c[3]}}] else [] end))
 from (select *, case when o[2] is not null and r[2] is null and u[2] + 70000.5 < next then u[2] + 70000.5 end as t1,
   case when o[2] is not null and r[2] is null and up[2] then case when e0 then d0 when r0 is not null or o[1] is null then t end end as f1, case when o[3] is not null and r[3] is null and up[3] then case when e0 then d0 when r0 is not null or o[1] is null then t end end as f2
  from (select *, r[1] as r0, o[1] is not null and r[1] is null and u[1] + 40000.5 < next as e0, u[1] + 40000.5 as d0
   from (select s.family, s.i, s.t, s.next, list_transform(f.o, lambda v, j: case when j = k + 1 and kind = 'raise' and (v is null or t - f.r[j] >= 90000) then t else v end) as o, list_transform(f.u, lambda v, j: case when j = k + 1 and kind = 'raise' then t else v end) as u,
     list_transform(f.r, lambda v, j: case when j = k + 1 and kind = 'raise' then null else v end) as r, list_transform(f.c, lambda v, j: case when j = k + 1 and kind = 'raise' then case when f.o[j] is null or t - f.r[j] >= 90000 then 1 else v + 1 end else v end) as c,
     list_transform(f.up, lambda v, j: case when j = k + 1 and kind <> 'raise' then kind = 'up' else v end) as up
    from f join (select *, (id - family)::INT as k from s) s on s.family = f.family and s.i = f.i + 1))))
select family, family + e.k as id, e.o as opened, e.t as resolved, e.w as reason, e.c as occurrences from (select family, unnest(e) as e from f)"""


@query("P17_alert_ends", ENDS)
def p17_ends(d: Data):
    rows = d.sql(FAMILIES)
    return O.ended_alerts(rows, rows.agg(F.max("t")).first()[0], 90000)


@query("P19_archived_alerts", f"select id, state = 'resolved' and {NOW} - floor(epoch(resolved_at)) > 86400 as archived from v_alerts where state <> 'x'")
def p19(d: Data):
    live, old = O.archive_split(d("v_alerts"), NOW)
    both = O.all_alerts(live.withColumn("archived", F.lit(False)), old.withColumn("archived", F.lit(True)))
    return both.select("id", "archived")


@query("P21_alert_list", "select id, severity, state, opened_at from v_alerts where severity in ('critical', 'major') and site_id = 2 and root_cause is null")
def p21(d: Data):
    return O.alert_list(d("v_alerts"), least="major", site=2, roots=True).select("id", "severity", "state", "opened_at")


@query("P22_evidence", "select dedup_key, string_agg(m, ', ' order by ts, id) as evidence from (select user_id::VARCHAR as dedup_key, event_id as id, ts, event_type || ' ' || strftime(ts, '%H:%M:%S') as m, row_number() over (partition by user_id order by ts, event_id) as n from events) where n <= 20 group by 1")
def p22(d: Data):
    return O.evidence(d("events").select(F.col("user_id").cast("string").alias("dedup_key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("source")))


@query("P23_operator_actions", "select id, case when id % 7 = 0 and state = 'open' then 'acked' when id % 7 = 1 then 'resolved' else state end as state from v_alerts")
def p23(d: Data):
    actions = d("v_alerts").where("id % 7 <= 1").select("id", F.col("opened_at").alias("at"), F.when(F.col("id") % 7 == 0, "ack").otherwise("resolve").alias("action"))
    return O.acted_on(d("v_alerts"), actions).select("id", "state")


_NOTIFY = "case when state = 'resolved' then notified else severity <> 'info' end"


#: Quiet from 22:00 to 06:00 on the alert's own clock; the moments lie around both changes of the clock in Berlin and in New York.
QUIET_AT = {4102488000: (0, 60, -300), 4102448400: (0, 60, -300), 1711854000: (0, 120, -240), 1711857600: (0, 120, -240), 1711846799: (0, 60, -240), 1730005200: (0, 60, -240), 1730606400: (0, 60, -240), 1730617200: (0, 60, -300)}


@query("P24_notifications", "".join(f"""{' union all ' if i else ''}
select id, {t}::BIGINT as at, row_number() over (order by case severity when 'critical' then 4 when 'major' then 3 when 'minor' then 2 else 1 end desc, opened_at, id)::INT as place
from (select *, ({t} // 60 + case id % 3 when 0 then {a} when 1 then {b} else {c} end) % 1440 as minute from v_alerts) where {_NOTIFY} and (severity = 'critical' or not (minute >= 1320 or minute < 360))""" for i, (t, (a, b, c)) in enumerate(QUIET_AT.items())))
def p24(d: Data):
    zone = F.element_at(F.array(F.lit(None), F.lit("Europe/Berlin"), F.lit("America/New_York")), (F.col("id") % 3 + 1).cast("int"))
    rows = d("v_alerts").withColumns({"updated_at": F.col("opened_at"), "zone": zone})
    made = [O.to_notify(rows, t, quiet=(1320, 360)).select("id", F.lit(t).cast("long").alias("at"), "place") for t in QUIET_AT]
    calm = O.to_notify(rows.where("severity <> 'critical'"), 1000).select("id", F.lit(1000).cast("long").alias("at"), "place")  # before the oldest update: the group window is open
    return reduce(lambda a, b: a.unionByName(b), [*made, calm])


@query("P25_rules", "select rule as id, case when rule in ('icmp_loss', 'probe_failed') then 'critical' when rule = 'device_down' then 'major' when rule = 'interface_down' then 'major' else 'major' end as severity, count(*) as alerts from v_alerts group by 1, 2")
def p25(d: Data):
    rules = O.rule_table(d.spark)
    changed = rules.where("id in ('icmp_loss', 'probe_failed')").withColumn("severity", F.lit("critical"))
    return d("v_alerts").select(F.col("rule").alias("id")).join(F.broadcast(O.rule_table(d.spark, changed)), "id").groupBy("id", F.col("severity")).agg(F.count("*").alias("alerts"))


LINKS = "select a_device, b_device, concat('GIGABITETHERNET1/', cast(1 + a_device % 7 as varchar(9))) as a_if, concat('Vlan', cast(1 + b_device % 7 as varchar(9))) as b_if from v_links"


@query("P26_link_status", f"""
select a_device, b_device, case when a.oper_up = false or b.oper_up = false then 'down' when a.oper_up is null and b.oper_up is null then 'unknown' when coalesce(a.oper_up, true) and coalesce(b.oper_up, true) and (a.oper_up is null or b.oper_up is null) then 'up' else 'up' end as status
from ({LINKS}) l left join v_interfaces a on a.device_id = a_device and lower(a.name) = lower(a_if) left join v_interfaces b on b.device_id = b_device and lower(b.name) = lower(b_if)""")
def p26(d: Data):
    return O.link_status(d.sql(LINKS), d("v_interfaces")).select("a_device", "b_device", "status")


PEERED = "select a_device, b_device, concat('GIGABITETHERNET1/', cast(1 + a_device % 7 as varchar(9))) as a_if, concat('Vlan', cast(1 + b_device % 7 as varchar(9))) as b_if, a_device % 6 = 1 as stale, b_device % 9 = 2 as external, concat('isp', cast(b_device as varchar(9))) as external_name from v_links"


@query("P26_named_peers", f"""
with e as (select a_device as device_id, lower(a_if) as k, case when external then external_name end as label, b_device as far, b_if as far_if from ({PEERED}) where not stale union all
 select b_device, lower(b_if), null, a_device, a_if from ({PEERED}) where not stale),
p as (select e.device_id, k, min(coalesce(label, name) || ' ' || far_if) as peer from e left join v_devices d on d.device_id = far where label is not null or name is not null group by 1, 2)
select i.device_id, i.if_index, peer from v_interfaces i left join p on p.device_id = i.device_id and p.k = lower(i.name)""")
def p26_peers(d: Data):
    return O.named_peers(d("v_interfaces"), d.sql(PEERED), d("v_devices")).select("device_id", "if_index", "peer")
