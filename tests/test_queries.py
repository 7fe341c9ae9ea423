"""A query of each family against its SQL in DuckDB; the driver compares all of them."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["M9_counter_rates", "M3_stream_rollup", "F5_top_talkers", "F12_window_totals", "L1_parsed_lines", "L5_log_events", "P4_device_status", "P12_upserted_alerts", "P20_maintenance", "T14_roles", "T15_parents", "E5_placed", "N1_peer_changes", "Q2_probe_events", "C2_versions", "D9_device_health", "R2_alert_causes", "X1_findings", "S4_tiered_files", "M11_kept_series", "L8_rate_limit", "P17_auto_resolved", "P12_stream_alerts", "T17_topology_nodes", "E9_search", "C1_normalised", "C3_line_diffs", "R4_busiest_interfaces"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) and abs(v) < 1e9 else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
