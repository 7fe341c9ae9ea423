"""Streams against their batch forms: late and disordered rows, replayed batches, jobs that are killed in between."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as A
from pulsegrid.operators import metrics as M
from pulsegrid.sources import files
from pulsegrid.streaming import jobs as J
from pulsegrid.streaming.keyed import late_rows


def landed(spark, path, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return J.intake(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_a_late_row_is_dropped_by_rule(spark, tmp_path):
    schema = "s string, t long, arrival long, v double"
    batches = [[(s, 86400 + t, n, v) for s, t, n, v in rows] for rows in [[("a", 100, 1, 1.0), ("a", 100, 2, 2.0), ("b", 7300, 3, 3.0)], [("a", 3500, 4, 9.0), ("b", 7250, 5, 9.0), ("b", 7300, 6, 4.0), ("a", 7200, 7, float("inf"))], [("a", 7200, 8, 5.0)]]]
    query = J.run(J.appended(landed(spark, f"{tmp_path}/in", schema, *batches), ["s"]), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    made = spark.read.parquet(f"{tmp_path}/out").groupBy("s", "t").agg(F.max_by("v", "arrival").alias("v"))
    assert sorted(map(tuple, made.collect())) == [("a", 86500, 2.0), ("a", 93600, 5.0), ("b", 93700, 4.0)] and late_rows(spark, query, f"{tmp_path}/checkpoint") == 1
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, M.accept_samples(rows, ["s"]).collect())) == sorted(map(tuple, made.collect()))


def test_actions_in_the_order_of_their_time(spark, tmp_path):
    """Rows of two streams that arrive in disorder within the lateness give the batch result; a later one is dropped and counted."""
    schema = "dedup_key string, t double, n long, action string, severity int, source string, root_cause string"
    act = lambda k, t, n, what: (k, float(t), n, what, 3, "x", None)
    monitors = [[act("k", 20, 2, "raise"), act("k", 10, 1, "raise")], [act("k", 70, 6, "raise"), act("k", 50, 4, "resolve")], [act("z", 1000, 9, "notified")]]
    hands = [[act("k", 30, 3, "ack")], [act("k", 60, 5, "manual"), act("z", 1000, 10, "notified")], [act("k", 25, 8, "ack")]]
    made = J.acted_alerts(landed(spark, f"{tmp_path}/a", schema, *monitors), landed(spark, f"{tmp_path}/b", schema, *hands), 1800, "30 seconds")
    query = J.run(made, f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").where("dedup_key = 'k'").orderBy("t").collect()
    want = A.upsert_alerts(spark.createDataFrame([r for b in monitors + hands for r in b if r[2] != 8], schema)).where("dedup_key = 'k'").first()
    assert [r.t for r in got] == [10, 20, 30, 50, 60, 70] and got[-1].state == want.state == "open" and got[-1].evidence == want.evidence and got[2].state == "acked" and late_rows(spark, query, f"{tmp_path}/checkpoint") == 1


def test_folds_in_order_of_times_beyond_pandas(spark, tmp_path):
    """Times after the year 2262, which pandas' timestamps don't reach: ends of alerts as in batch."""
    at, schema = 1e10, "family long, t double, n long, id long, kind string, lasts double"
    batches = [[(10, at + 10, 1, 10, "raise", 50.5), (10, at + 20, 2, 11, "raise", None)], [(10, at + 200, 3, 11, "up", None)], [(10, at + 400, 4, 12, "raise", None)]]
    J.run(J.ended(landed(spark, f"{tmp_path}/in", schema, *batches)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    want = A.ended_alerts(spark.createDataFrame([r for b in batches for r in b], schema), at + 400)
    made = spark.read.parquet(f"{tmp_path}/out")
    assert made.count() == 2 and sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


def test_actions_of_a_busy_key_beyond_pandas(spark, tmp_path, monkeypatch):
    """Actions after the year 2262, more of a key than an entry of the state holds; a bucket's waiting rows are few entries."""
    from pulsegrid.streaming import keyed

    monkeypatch.setattr(keyed, "PACK", 50, raising=False)
    schema, kinds = "dedup_key string, t double, n long, action string, severity int, source string, root_cause string", ["raise", "resolve", "raise", "notified", "ack", "manual"]
    acts = [[("k", 1e10 + 100 * n, n, kinds[(n * n + n // 7) % 6], n % 4, "x", None) for n in range(150 * b, 150 * b + 150)] for b in range(3)]
    monitors, hands = [[[r for r in b if (r[3] in ("ack", "manual")) == own] for b in acts] for own in (False, True)]
    end = [("z", 1e10 + 100000, 1000, "notified", 3, "x", None)]
    made = J.acted_alerts(landed(spark, f"{tmp_path}/a", schema, *monitors, end), landed(spark, f"{tmp_path}/b", schema, *hands, end), 150)
    J.run(made, f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").where("dedup_key = 'k'")
    names = ["state", "opened", "updated", "resolved", "occurrences", "notified", "evidence"]
    last = rows.groupBy(F.col("_k").alias("n")).agg(F.max_by(F.struct(*names), "t").alias("x")).select("n", "x.*")
    want = A.upsert_alerts(spark.createDataFrame([r for b in acts for r in b], schema), 150).select("n", *names)
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect())) and want.count() > 1
    state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "waiting").option("batchId", 0).load()
    assert state.count() <= 4


def bucket(t, v, s="a"):
    return (s, t, v)


def test_rollups_in_place(spark, tmp_path, monkeypatch):
    """A job that is killed before or after its commit record, and one run again, leave the same table."""
    path, schema = f"{tmp_path}/rollup", "s string, t long, v double"
    stored = spark.createDataFrame([bucket(0, 1.0), bucket(300, 1.0), bucket(86400, 1.0), bucket(172800, 1.0)], schema)
    fresh = spark.createDataFrame([bucket(300, 2.0), bucket(86700, 2.0)], schema)
    table = lambda: sorted((r.s, r.t, r.v) for r in spark.read.parquet(path).collect())
    want = [bucket(0, 1.0), bucket(300, 2.0), bucket(86400, 1.0), bucket(86700, 2.0), bucket(172800, 1.0)]
    assert files.replace_buckets(stored, path, ["s"], "one")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "_swap_in", killed)
        with pytest.raises(KeyboardInterrupt):
            files.replace_buckets(fresh, path, ["s"], "two")
    assert table() == sorted(map(tuple, stored.collect()))
    assert files.recover(spark, path) == ["two"] and table() == want
    assert not files.replace_buckets(fresh, path, ["s"], "two") and table() == want
    store = files.Store(spark, path)
    spark.createDataFrame([bucket(300, 9.0)], schema).write.parquet(f"{path}/_staging/three")
    store.delete(f"{path}/_staging/three/_SUCCESS")  # killed before its record
    assert files.replace_buckets(spark.createDataFrame([bucket(300, 3.0)], schema), path, ["s"], "three") and (("a", 300, 3.0)) in table() and len(table()) == 5


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    sink = files.deliver(str(tmp_path))
    for rows in ([(1, "open")], [(1, "other")]):
        sink(spark.createDataFrame(rows, "id long, state string"), 7)
    assert [r.state for r in spark.read.json(str(tmp_path)).collect()] == ["open"]


def test_keys_of_a_bucket_share_a_call_and_a_state(spark, tmp_path, monkeypatch):
    """Many keys, a null one too, in two buckets: each key keeps its own fold, and the state has an entry for each bucket."""
    from pulsegrid.operators.state import sliding_count, thresholds
    from pulsegrid.streaming import keyed

    monkeypatch.setattr(keyed, "BUCKETS", 2, raising=False)
    schema = "sample_id long, device_id long, ts timestamp, v double"
    rows = spark.range(600).selectExpr("id as sample_id", "nullif(id % 40, 7) as device_id", "timestamp_seconds(1704067200 + id * 60) as ts", "cast(id * 37 % 100 as double) as v")
    batches = [[tuple(r) for r in rows.where(f"floor(sample_id / 200) = {k}").collect()] for k in range(3)]
    stream = landed(spark, f"{tmp_path}/in", schema, *batches)
    J.run(J.thresholds(stream, 60, 20, 2), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    want = thresholds(rows, "device_id", "v", ["ts", "sample_id"], 60, 20, 2).select("device_id", "sample_id", "on")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, want.collect()))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "folds").load()
    assert state.select("key").distinct().count() == 2
    counted = J.bursts(stream.select("device_id", F.col("ts").cast("double").alias("t"), F.col("sample_id").alias("n")).where("device_id is not null"), "device_id", 7200, 2)
    J.run(counted, f"{tmp_path}/checkpoint2", f"{tmp_path}/out2")
    last = rows.agg(F.max("ts")).first()[0]  # what the watermark hasn't passed waits
    want = sliding_count(rows.where("device_id is not null"), "device_id", 7200, 2).where(F.col("ts") <= F.lit(last)).select("device_id", "sample_id", F.col("recent").cast("int").alias("recent"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out2").collect())) == sorted(map(tuple, want.collect()))
