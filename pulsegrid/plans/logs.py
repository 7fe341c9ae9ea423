"""Queries L1 to L12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import SEVERITIES, severity_name
from ..operators import logs as O
from .registry import Data, query

START, STOP = 1704499200, 1705363200  # 2024-01-06 to 2024-01-16

PARSED = """
select log_id, host, recv, pri, rest, is5424, f,
  trim(case when is5424 then ltrim(substr(rest, length(array_to_string(f[1:6], ' ')) + 2), '- ') when bsd is not null then ltrim(replace(ltrim(substr(rest, instr(rest, bsd) + 15), '.0123456789'), ' UTC', ''), ': ') else rest end) as message,
  case when is5424 then f[4] end as app, case when is5424 then f[2] end as stamp, bsd
from (select *, case when not is5424 and contains(substr(rest, 1, 40), ':') and regexp_matches(substr(rest, 1, 40), '[0-9]:[0-9][0-9]:[0-9]') then substr(rest, instr(rest, 'Jan '), 15) end as bsd
 from (select *, string_split(rest, ' ') as f, starts_with(rest, '1 ') as is5424 from (
  select log_id, host, recv, case when starts_with(raw, '<') then substr(raw, 2, instr(raw, '>') - 2)::int end as pri, case when starts_with(raw, '<') then substr(raw, instr(raw, '>') + 1) else raw end as rest from v_syslog_lines)))"""
CODED = f"""
select *, case when contains(message, '%') then split_part(split_part(message, '%', 2), ':', 1) end as code, contains(message, 'logid=') as fgt,
  split_part(split_part(message, ' type="', 2), '"', 1) as ty, split_part(split_part(message, 'subtype="', 2), '"', 1) as sub, split_part(split_part(message, 'level="', 2), '"', 1) as lev, split_part(split_part(message, 'logdesc="', 2), '"', 1) as descr
from ({PARSED})"""
DONE = rf"""
select log_id, host, recv, coalesce(pri // 8, 1)::INT as facility,
  coalesce(try_cast(split_part(code, '-', 2) as int), case when fgt then case lev when 'critical' then 2 when 'notice' then 5 end end, pri % 8, 6)::INT as severity,
  coalesce(code, case when fgt then 'FGT-' || ty || '-' || sub || '-' || replace(upper(descr), ' ', '_') end, case when is5424 and app <> '-' then app end, '') as mnemonic, message, own, stamp, bsd
from (select *, coalesce(try_cast(stamp as timestamp), case when bsd is not null then
   case when epoch(try_strptime(year(recv)::VARCHAR || ' ' || bsd, '%Y %b %d %H:%M:%S')) - floor(epoch(recv)) > 172800 then try_strptime((year(recv) - 1)::VARCHAR || ' ' || bsd, '%Y %b %d %H:%M:%S')
        else try_strptime(year(recv)::VARCHAR || ' ' || bsd, '%Y %b %d %H:%M:%S') end end) as own from (select * replace (regexp_replace(bsd, ' +', ' ', 'g') as bsd) from ({CODED})))"""


@query("L1_parsed_lines", f"select log_id, host, facility, severity, mnemonic, message from ({DONE})")
def l1(d: Data):
    return O.parse_lines(d("v_syslog_lines")).select("log_id", "host", "facility", "severity", "mnemonic", "message")


@query("L2_repaired_times", f"select log_id, case when own is null or epoch(own) - epoch(recv) > 300 or epoch(own) - epoch(recv) < -86400 then recv else own end as ts from ({DONE})")
def l2(d: Data):
    return O.parse_lines(d("v_syslog_lines")).select("log_id", "ts")


@query("L3_key_values", f"select log_id, ty as type, lev as level, replace(upper(descr), ' ', '_') as description, 5 as n from ({CODED}) where fgt and code is null")
def l3(d: Data):
    rows = O.parse_lines(d("v_syslog_lines")).where("kv is not null")
    return rows.select("log_id", F.col("kv")["type"].alias("type"), F.col("kv")["level"].alias("level"), F.replace(F.upper(F.col("kv")["logdesc"]), F.lit(" "), F.lit("_")).alias("description"), F.size("kv").alias("n"))


@query("L4_line_sources", """
select host, name as device, count(*) as lines, name is not null as known from v_syslog_lines left join v_devices on device_id = host group by 1, 2""")
def l4(d: Data):
    lines, devices = d("v_syslog_lines"), d("v_devices")
    known = O.known_sources(lines, devices).where("device is not null").groupBy("host", "device").agg(F.count("*").alias("lines")).withColumn("known", F.lit(True))
    unknown = O.unknown_sources(lines, devices).select("host", F.lit(None).cast("string").alias("device"), "lines", F.lit(False).alias("known"))
    return known.unionByName(unknown)


EVENTS = rf"""
select log_id, host as device_id, severity, kind, case when kind in ('link_down', 'bgp_neighbor_down', 'ha_state_change', 'critical_log') then 'major' when kind = 'config_changed' then 'minor' else 'info' end as event_severity, subject from (
select *, case fam when 'link' then case when contains(lower(message), 'to down') then 'link_down' else 'link_up' end when 'config' then 'config_changed'
  when 'bgp' then case when contains(message, 'Down') then 'bgp_neighbor_down' else 'bgp_neighbor_up' end when 'ha' then 'ha_state_change' else 'critical_log' end as kind,
  case fam when 'link' then nullif(split_part(split_part(message, 'Interface ', 2), ',', 1), '') when 'config' then nullif(split_part(split_part(message, ' by ', 2), ' ', 1), '')
  when 'bgp' then nullif(split_part(split_part(message, 'neighbor ', 2), ' ', 1), '') end as subject
from (select *, case when starts_with(mnemonic, 'LINK-') and contains(mnemonic, 'UPDOWN') then 'link' when contains(mnemonic, 'CONFIG_I') then 'config' when starts_with(mnemonic, 'BGP-') and contains(mnemonic, 'ADJCHANGE') then 'bgp'
  when contains(lower(message), 'ha state changed') then 'ha' when severity <= 2 then 'critical' end as fam from ({DONE})) where fam is not null) where kind not in ('link_down', 'link_up') or subject is not null"""


def _events(d: Data):
    return O.classify(O.parse_lines(d("v_syslog_lines")).withColumn("device_id", F.col("host")))


@query("L5_log_events", EVENTS)
def l5(d: Data):
    return _events(d).select("log_id", "device_id", "severity", "kind", "event_severity", "subject")


@query("L6_trap_events", """
select t.trap_id, t.device_id, case oid when '1.3.6.1.6.3.1.1.5.3' then 'link_down' when '1.3.6.1.6.3.1.1.5.4' then 'link_up' when '1.3.6.1.6.3.1.1.5.1' then 'device_rebooted' when '1.3.6.1.6.3.1.1.5.5' then 'auth_failure'
 when '1.3.6.1.2.1.15.7.2' then 'bgp_neighbor_down' when '1.3.6.1.4.1.9.9.13.3.0.1' then 'environment_fault' else 'vendor_trap' end as kind,
 case when trap_id % 7 in (0, 2, 4, 5) then 'major' when trap_id % 7 = 6 then 'minor' else 'info' end as severity,
 case when trap_id % 7 <= 1 then coalesce(i.name, 'ifIndex ' || t.if_index::VARCHAR) end as label
from v_traps t left join v_interfaces i on i.device_id = t.device_id and i.if_index = t.if_index""")
def l6(d: Data):
    return O.classify_traps(d("v_traps"), d("v_interfaces")).select("trap_id", "device_id", "kind", "severity", "label")


@query("L7_storm_suppression", """
with recursive s as (select event_id, user_id, event_type, epoch(ts) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
f as (select event_id, user_id, event_type, n, true as kept, t as last from s where n = 1 union all
  select s.event_id, s.user_id, s.event_type, s.n, s.t - f.last >= 43200, case when s.t - f.last >= 43200 then s.t else f.last end from f join s on s.user_id = f.user_id and s.event_type = f.event_type and s.n = f.n + 1)
select event_id, user_id, event_type from f where kept""")
def l7(d: Data):
    rows = d("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return O.suppress_storms(rows, ["user_id", "event_type"], ["event_id"], 43200).drop("t")


#: Tokens are counted in whole seconds times the rate: the interval of the values keeps them exact in both engines.
@query("L8_rate_limit", """
with recursive s as (select user_id, event_id as n, floor(epoch(ts)) as t, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as i from events),
f as (select user_id, n, t, i, 1.0e0 as tokens, true as passed, false as flood, false as flooding from s where i = 1 union all
  select user_id, n, t, i, have, have >= 1, have < 1 and not flooding, have < 1 or (flooding and have - 1 <= 1) from (
    select s.user_id, s.n, s.t, s.i, least(2.0e0, tokens - passed::INT + (s.t - f.t) * 0.0000152587890625) as have, flooding
    from f join s on s.user_id = f.user_id and s.i = f.i + 1))
select user_id, n, passed, flood from f""")
def l8(d: Data):
    rows = d("events").select("user_id", F.col("event_id").alias("n"), F.floor(F.col("ts").cast("timestamp").cast("double")).alias("t"))
    return O.limit_rate(rows, "user_id", 1 / 65536, 2.0, 1.0).drop("t")


@query("L9_log_search", f"""
select log_id, recv, device_id, severity, source, mnemonic, message from v_log_entries where floor(epoch(recv)) between {START} and {STOP} and severity <= 4 and source = 'syslog'
and (contains(lower(message), 'user 1') or contains(lower(mnemonic), 'user 1')) order by recv desc, log_id desc limit 500""")
def l9(d: Data):
    return O.search(d("v_log_entries"), START, STOP, severity=4, source="syslog", text="USER 1").select("log_id", "recv", "device_id", "severity", "source", "mnemonic", "message")


@query("L10_log_histogram", f"""
with h as (select recv from v_log_entries where floor(epoch(recv)) between {START} and {STOP} order by recv desc, log_id desc limit 100000),
c as (select least(greatest(floor((epoch(recv) - {START}) / ({STOP} - {START}) * 48), 0), 47)::BIGINT as bucket, count(*) as lines from h group by 1)
select b.bucket, coalesce(lines, 0) as lines from (select unnest(range(48))::BIGINT as bucket) b left join c using (bucket)""")
def l10(d: Data):
    return O.histogram(d("v_log_entries"), START, STOP)


@query("L11_recent_events", "select log_id, device_id, recv, place from (select *, row_number() over (partition by device_id order by recv desc, log_id desc) as place from v_log_entries where source = 'syslog') where place <= 20")
def l11(d: Data):
    return O.recent_events(d("v_log_entries").where("source = 'syslog'")).select("log_id", "device_id", "recv", "place")


@query("L12_severity_names", "select log_id, case severity " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SEVERITIES)) + " end as severity from v_log_entries")
def l12(d: Data):
    return d("v_log_entries").select("log_id", severity_name(F.col("severity")).alias("severity"))
