"""Queries Q1 to Q5 and C1 to C7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as O
from .registry import Data, query


@query("Q1_probe_summary", """
with l as (select *, row_number() over (partition by probe_id order by ts desc, run_id desc) as n from v_probe_results)
select probe_id, count(*) as runs, round(avg(ok::INT) * 100, 6) as ok_pct, round(avg(case when ok then ms end), 6) as mean_ms, max_by(ok, -n) as last_ok, coalesce(min(case when ok then n end), count(*) + 1) - 1 as fail_streak from l where n <= 120 group by 1""")
def q1(d: Data):
    return O.probe_summary(d("v_probe_results"))


@query("Q2_probe_events", """
with a as (select *, coalesce((ok <> lag(ok) over w)::INT, 0) as flip from v_probe_results window w as (partition by probe_id order by ts, run_id)),
b as (select *, sum(flip) over (partition by probe_id order by ts, run_id) as run from a), c as (select *, row_number() over (partition by probe_id, run order by ts, run_id) as n from b),
f as (select *, case when ok then 0 else n end as fails from c), g as (select *, lag(fails) over (partition by probe_id order by ts, run_id) as was from f)
select probe_id, run_id, case when fails = 2 then 'probe_failed' else 'probe_ok' end as kind from g where fails = 2 or (ok and was >= 2)""")
def q2(d: Data):
    return O.probe_events(d("v_probe_results"))


CODES = "select event_id as id, cast(200 + event_id % 300 as int) as code, case event_id % 4 when 0 then '200-299,301' when 1 then '404' when 2 then '200-399' else ' 250 , 400-450' end as wanted from events"


@query("Q3_status_matches", f"select id, case id % 4 when 0 then code between 200 and 299 or code = 301 when 1 then code = 404 when 2 then code between 200 and 399 else code = 250 or code between 400 and 450 end as ok from ({CODES})")
def q3(d: Data):
    return d.sql(CODES).select("id", O.status_matches(F.col("code"), F.col("wanted")).alias("ok"))


CERTS = "select probe_id, run_id, ts, timestamp '2024-01-14 00:00:00' + interval '1' hour * cast(run_id % 5 * 220 as int) as expires from v_probe_results"


@query("Q4_certificates", f"""
with a as (select *, round((epoch(expires) - epoch(ts)) / 86400, 6) as days from ({CERTS})), b as (select *, coalesce(lag(days < 14) over (partition by probe_id order by ts, run_id), false) as was from a)
select probe_id, run_id, days, case when days < 0 then 'expired' when days < 14 and not was then 'expiring' else 'renewed' end as kind from b where days < 0 or (days < 14 and not was) or (days >= 14 and was)""")
def q4(d: Data):
    return O.certificate_events(d.sql(CERTS))


@query("Q5_route_changes", """
with p as (select probe_id, run_id, ts, 'a>' || case when run_id % 3 = 0 then '' else 'b' || (run_id % 2)::VARCHAR || '>' end || 'c' as path from v_probe_results)
select probe_id, run_id, previous, path from (select *, lag(path) over (partition by probe_id order by ts, run_id) as previous from p) where previous <> path""")
def q5(d: Data):
    middle = F.when(F.col("run_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("b"), (F.col("run_id") % 2).cast("string")))
    rows = d("v_probe_results").select("probe_id", "run_id", "ts", F.array(F.lit("a"), middle, F.lit(None), F.lit("c")).alias("hops"))
    return O.route_changes(rows)


#: Each version's whole text is seen twice, each time behind another volatile line of the device's platform and with trailing blanks.
HEADS = {"cisco-ios": "! Time: %", "cisco-nxos": "!Command: %", "cisco-asa": "ASA Version %", "fortinet-fortigate": "#buildno=%", "paloalto": "[edit] %", "juniper": "## Last commit: %", "aruba-aos-s": "; Ver %", "aruba-aos-cx": "!Version %", "mikrotik": "# software id = %", "huawei": "!Software Version %", "ubiquiti": "set system x login %", "net-snmp": "  valid_lft %", "generic": "! last change %", "other": "! updated %"}
_PLATFORM = "case device_id % 14 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(HEADS)) + " end"
_HEAD = "case device_id % 14 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(HEADS.values())) + " end"
CONFIGS = f"select device_id, seq * 2 + k as seq, {_PLATFORM} as platform, source, concat(replace({_HEAD}, '%', cast(seq * 2 + k as varchar(9))), chr(10), '  ', config, chr(9), ' ', chr(10), chr(10)) as config from v_config_versions, (select 0 as k union all select 1) two"
NORMAL = "trim(array_to_string(list_transform(list_filter(string_split(config, chr(10))[2:], lambda x: device_id % 14 <> 2 or trim(x) <> ''), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) || chr(10)"


@query("C1_normalised", f"select device_id, seq, md5({NORMAL}) as hash from ({CONFIGS})")
def c1(d: Data):
    return d.sql(CONFIGS).select("device_id", "seq", F.md5(O.normalised(F.col("config"), F.col("platform")).cast("binary")).alias("hash"))


@query("C2_versions", f"""
with h as (select device_id, seq, sha256({NORMAL}) as hash from ({CONFIGS})), n as (select *, coalesce((hash <> lag(hash) over (partition by device_id order by seq))::INT, 1) as new from h),
v as (select *, sum(new) over (partition by device_id order by seq) as version from n)
select device_id, version::BIGINT as version, min(seq) as seq, count(*) - 1 as unchanged from v group by 1, 2""")
def c2(d: Data):
    return O.versions(d.sql(CONFIGS), F.col("platform")).select("device_id", "version", "seq", "unchanged")


LINES = "select device_id, seq, replace(replace(config, '. ', concat('.', chr(10))), ', ', chr(10)) as config from v_config_versions"


#: Lengths of longest common subsequences: a row of the table for each line of the old text, each a running maximum over the row before.
_LCS = """l as (select *, string_split(old, chr(10)) as x, string_split(new, chr(10)) as y from p),
f as (select id, 0 as i, list_transform(range(0, len(y) + 1), lambda k: 0) as row from l union all
 select id, i + 1, list_prepend(0, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))) from (
  select l.id, f.i, list_transform(range(1, len(y) + 1), lambda j: greatest(f.row[j + 1], case when y[j] = x[f.i + 1] then f.row[j] + 1 else 0 end)) as c from f join l on l.id = f.id and f.i < len(x))),
d as (select l.*, (len(y) - f.row[-1])::INT as added, (len(x) - f.row[-1])::INT as removed from l join f on f.id = l.id and f.i = len(x))"""
_STEPS = f"select device_id, seq, device_id * 1000 + seq as id, lag(config) over (partition by device_id order by seq) as old, config as new from ({LINES})"


@query("C3_line_diffs", f"with recursive p as (select * from ({_STEPS}) where old is not null), {_LCS} select device_id, seq, added, removed from d")
def c3(d: Data):
    return O.diffs(O.consecutive(d.sql(LINES))).select("device_id", "seq", "added", "removed")


_ENDS = f"select device_id, min(seq) as old_seq, max(seq) as new_seq from ({LINES}) x group by device_id"


@query("C3_any_two", f"with recursive e as ({_ENDS}), p as (select e.*, e.device_id as id, o.config as old, n.config as new from e join ({LINES}) o on o.device_id = e.device_id and o.seq = old_seq join ({LINES}) n on n.device_id = e.device_id and n.seq = new_seq), {_LCS} select device_id, old_seq, new_seq, added, removed from d")
def c3_any_two(d: Data):
    return O.diffs(O.chosen(d.sql(LINES), d.sql(_ENDS))).select("device_id", "old_seq", "new_seq", "added", "removed")


@query("C4_hunks")
def c4(d: Data):
    return O.diffs(O.consecutive(d.sql(LINES))).select("device_id", "seq", "n_hunks", "diff")


@query("C5_newest_versions", "select device_id, seq from (select *, row_number() over (partition by device_id order by seq desc) as n from v_config_versions) where n <= 2")
def c5(d: Data):
    return O.keep_newest(d("v_config_versions"), "device_id", "seq", 2).select("device_id", "seq")


BACKUPS = "select user_id as device_id, event_id as at, case when event_type = 'error' then 'timeout' end as error from events"


@query("C6_backup_overview", f"select d.device_id, coalesce(count(b.at), 0) as runs, max(b.at) as last_run, arg_max_null(b.error, b.at) as error from v_devices d left join ({BACKUPS}) b using (device_id) group by 1")
def c6(d: Data):
    return O.backup_overview(d("v_devices"), d.sql(BACKUPS))


@query("C7_backup_events", f'''select device_id, "at", case when bad then 'failing' else 'working' end as kind from (select device_id, "at", error is not null as bad, coalesce(lag(error is not null) over (partition by device_id order by "at"), false) as was from ({BACKUPS})) where bad <> was''')
def c7(d: Data):
    return O.backup_events(d.sql(BACKUPS))
