"""Network-shaped views over the given tables, in SQL that Spark and DuckDB both run."""

VIEWS = {
    "v_sites": "select r_regionkey as site_id, r_name as name from region",
    "v_devices": """
select s_suppkey as device_id, n_regionkey as site_id, s_name as name, s_nationkey as vendor_key,
       case when s_suppkey = 0 then 'router' when s_suppkey <= 2 then 'core' when s_suppkey <= 8 then 'distribution'
            when s_suppkey % 11 = 0 then 'ap' else 'access' end as role,
       (s_suppkey % 7 <> 6) as monitored,
       concat('10.', cast(n_regionkey as varchar(9)), '.', cast(cast(floor(s_suppkey / 250) as bigint) as varchar(9)), '.', cast(s_suppkey % 250 + 1 as varchar(9))) as ip,
       case s_suppkey % 5 when 0 then 'down' when 1 then 'degraded' else 'up' end as status
from supplier join nation on s_nationkey = n_nationkey""",
    "v_interfaces": """
select l_suppkey as device_id, l_linenumber as if_index, (l_linenumber <= 2) as important,
       concat(case l_linenumber % 3 when 0 then 'Vlan' when 1 then 'GigabitEthernet1/' else 'Port-channel' end, cast(l_linenumber as varchar(9))) as name,
       case when l_linenumber <= 2 then 'to-core uplink' else 'desk' end as alias,
       cast(case when l_linenumber <= 2 then 10000 else 1000 end as bigint) as speed_mbps,
       case l_linenumber % 3 when 0 then 'vlan' when 1 then 'phys' else 'lag' end as kind,
       (l_suppkey + l_linenumber) % 13 <> 0 as admin_up, (l_suppkey * 3 + l_linenumber) % 5 <> 0 as oper_up,
       cast(sum(cast(floor(l_extendedprice) as bigint)) * 8 as double) as in_bps, cast(sum(cast(floor(l_extendedprice) as bigint)) * 3 as double) as out_bps,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) % 4 as err_rate
from lineitem group by l_suppkey, l_linenumber""",
    "v_if_counters": """
select device_id, if_index, ts, sum(oct) over w % 4294967296 as in_oct32, sum(oct) over w as in_oct64, sum(errs) over w as in_err,
       cast((dayofyear(ts) + device_id) % 40 * 86400 as bigint) as uptime
from (select l_suppkey as device_id, l_linenumber as if_index, l_shipdate as ts,
             cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) * 64 as oct,
             cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as errs
      from lineitem group by l_suppkey, l_linenumber, l_shipdate) d
window w as (partition by device_id, if_index order by ts rows between unbounded preceding and current row)""",
    "v_metric_samples": "select event_type as metric, user_id as device_id, ts, event_id as arrival, value as v from events",
    "v_device_samples": """
select event_id as sample_id, user_id as device_id, ts, (event_type <> 'error') as reachable, (event_id % 6 <> 0) as snmp_ok,
       value as rtt_ms, value % 100 as cpu_pct, case when event_type = 'error' then 100.0 else value % 30 end as loss_pct
from events""",
    "v_flow_records": """
select l_suppkey as exporter, o_custkey as src, l_partkey as dst, cast(l_partkey * 37 % 1024 as int) as dst_port,
       cast(1024 + o_custkey * 131 % 60000 as int) as src_port,
       case when l_returnflag = 'A' then 17 when l_returnflag = 'R' then 1 else 6 end as proto,
       l_linenumber as in_if, cast(l_orderkey % 8 as int) as out_if,
       cast(floor(l_extendedprice) as bigint) as bytes, cast(l_quantity as bigint) as packets, l_shipdate as ts
from lineitem join orders on l_orderkey = o_orderkey""",
    "v_neighbor_obs": """
select s_suppkey as device_id, 'Gi0/1' as local_if, cast(floor(s_suppkey / 3) as bigint) as remote_id,
       concat('Gi1/', cast(s_suppkey % 3 as varchar(10))) as remote_if, 'lldp' as source
from supplier where s_suppkey > 0
union all
select cast(floor(s_suppkey / 3) as bigint), concat('Gi1/', cast(s_suppkey % 3 as varchar(10))), s_suppkey, 'Gi0/1',
       case when s_suppkey % 2 = 0 then 'cdp' else 'lldp' end
from supplier where s_suppkey > 0 and s_suppkey % 4 <> 0""",
    "v_fdb": """
select l_suppkey as device_id, l_linenumber as if_index, lower(lpad(hex(l_partkey), 12, '0')) as mac,
       l_shipdate as ts, l_orderkey as arrival, cast(l_orderkey % 20 as int) as vlan
from lineitem""",
    "v_log_entries": """
select event_id as log_id, ts as recv, user_id as device_id, cast(event_id % 8 as int) as severity,
       case when event_id % 10 = 0 then 'trap' else 'syslog' end as source,
       upper(event_type) as mnemonic, concat(event_type, ' from user ', cast(user_id as varchar(20)), ' ', props) as message
from events""",
    "v_probe_results": "select user_id % 50 as probe_id, ts, event_id as run_id, (event_type <> 'error') as ok, value as ms from events",
    "v_peer_snapshots": """
select l_suppkey as device_id, l_partkey % 20 as peer, year(l_shipdate) * 12 + month(l_shipdate) as snapshot,
       count(*) as prefixes, (sum(l_quantity) >= 25) as up
from lineitem group by l_suppkey, l_partkey % 20, year(l_shipdate) * 12 + month(l_shipdate)""",
    "v_config_versions": "select conv_id as device_id, turn as seq, role as source, text as config from conversations",
    # alerts, one for each event: rule, severity and state follow from its number
    "v_alerts": """
select event_id as id, user_id as device_id, user_id % 5 as site_id, concat(cast(user_id as varchar(20)), ':', cast(event_id % 7 as varchar(9))) as object,
       case event_id % 5 when 0 then 'device_down' when 1 then 'icmp_loss' when 2 then 'interface_down' when 3 then 'bgp_neighbor_down' else 'probe_failed' end as rule,
       case event_id % 4 when 0 then 'critical' when 1 then 'major' when 2 then 'minor' else 'info' end as severity,
       case event_id % 3 when 0 then 'open' when 1 then 'acked' else 'resolved' end as state,
       ts as opened_at, case when event_id % 3 = 2 then ts + interval '1' minute * cast(5 + event_id % 240 as int) end as resolved_at,
       1 + event_id % 9 as occurrences, case when event_id % 10 = 3 then event_id - 1 end as root_cause,
       concat(event_type, ' on device ', cast(user_id as varchar(20))) as title, (event_id % 2 = 0) as notified
from events""",
    # raw log lines in four dialects
    "v_syslog_lines": """
select event_id as log_id, user_id as host, ts as recv,
       case event_id % 5
         when 0 then concat('<189>', cast(event_id as varchar(20)), ': *Jan  5 14:31:06.412 UTC: %LINK-3-UPDOWN: Interface GigabitEthernet1/0/', cast(event_id % 48 as varchar(9)), ', changed state to ', case when event_id % 2 = 0 then 'down' else 'up' end)
         when 1 then concat('<133>Jan 20 14:31:06 ', 'sw', cast(user_id as varchar(9)), ' %SYS-5-CONFIG_I: Configured from console by admin', cast(event_id % 3 as varchar(9)), ' from 10.0.0.', cast(event_id % 200 as varchar(9)))
         when 2 then concat('<13>1 2024-01-10T10:00:00Z fw', cast(user_id as varchar(9)), ' app', cast(event_id % 4 as varchar(9)), ' - - - logid="0100', cast(event_id % 100 as varchar(9)), '" type="event" subtype="ha" level="', case when event_id % 2 = 0 then 'critical' else 'notice' end, '" logdesc="HA state changed"')
         when 3 then concat('<187>: %BGP-5-ADJCHANGE: neighbor 10.1.1.', cast(event_id % 250 as varchar(9)), case when event_id % 2 = 0 then ' Down' else ' Up' end)
         else concat('garbage ', event_type, ' ', props) end as raw
from events""",
    "v_traps": """
select event_id as trap_id, user_id as device_id, ts as recv,
       case event_id % 7 when 0 then '1.3.6.1.6.3.1.1.5.3' when 1 then '1.3.6.1.6.3.1.1.5.4' when 2 then '1.3.6.1.6.3.1.1.5.1' when 3 then '1.3.6.1.6.3.1.1.5.5'
            when 4 then '1.3.6.1.2.1.15.7.2' when 5 then '1.3.6.1.4.1.9.9.13.3.0.1' else '1.3.6.1.4.1.12356.101.2.0.301' end as oid, event_id % 7 + 1 as if_index
from events""",
    # links of both ends, as two-sided rows of the neighbour observations
    "v_links": """
select least(device_id, remote_id) as a_device, greatest(device_id, remote_id) as b_device,
       min(case when device_id < remote_id then local_if else remote_if end) as a_if, min(case when device_id < remote_id then remote_if else local_if end) as b_if,
       count(*) as sides, case when count(*) > 1 then 1.0 else 0.8 end as confidence
from v_neighbor_obs where device_id <> remote_id group by least(device_id, remote_id), greatest(device_id, remote_id)""",
    "v_arp": """
select l_suppkey as device_id, lower(lpad(hex(l_partkey), 12, '0')) as mac, concat('10.2.', cast(l_partkey % 200 as varchar(9)), '.', cast(l_orderkey % 250 as varchar(9))) as ip,
       l_shipdate as ts, l_linenumber as if_index
from lineitem""",
    "v_maintenance": """
select event_id as id, ts as from_ts, ts + interval '1' minute * cast(60 + event_id % 120 as int) as to_ts, case when event_id % 3 = 0 then user_id end as device_id,
       case when event_id % 3 = 1 then user_id % 5 end as site_id
from events where event_type = 'signup' and event_id % 50 = 0""",
}
