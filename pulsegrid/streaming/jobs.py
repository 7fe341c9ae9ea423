"""Streams of samples, events and flows: intake, rollups, keyed state and timers (S9 and the streaming side of M3, F4, P2, P4, P12, P18, L7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.alerts import ACTION, ENDED, FAMILY_ROW, UPSERTED, Alert, Family, with_texts
from ..operators.state import Status, Threshold
from .keyed import by_arrival, event_time, in_order


def intake(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100, form: str = "parquet") -> DataFrame:
    """A stream over files (Parquet, or JSON lines, of which those that don't parse are skipped) that collectors land in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("mode", "DROPMALFORMED").json(path) if form == "json" else reader.format(form).load(path)


def from_bus(spark: SparkSession, servers: str, topic: str, schema: StructType) -> DataFrame:
    """A stream of JSON messages of a Kafka topic; the connector has to be on the cluster."""
    return messages(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load(), schema)


def messages(rows: DataFrame, schema: StructType) -> DataFrame:
    """Fields of the JSON objects in `value`; messages that aren't objects are skipped."""
    made = rows.select(F.from_json(F.col("value").cast("string"), schema).alias("x")).where("x is not null")
    return made.select("x.*")


def run(stream: DataFrame, checkpoint: str, sink: str | Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there, and gives the finished query. A function takes each batch; append goes to a file sink, update and complete write each batch to a folder of its own."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if callable(sink):
        query = writer.foreachBatch(sink).start()
    elif mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        query = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The newest row of each key over the batches of an update sink."""
    rows = spark.read.parquet(sink)
    value = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("x")).select(*keys, "x.*")


def rollup(stream: DataFrame, series: list[str], late: str = "1 hour", width: str = "5 minutes") -> DataFrame:
    """Bucket averages with a watermark: state of a bucket goes once it is `late` behind."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = rows.groupBy(*series, F.window("ts", width)).agg(F.round(F.avg("v"), 6).alias("v"), F.min("v").alias("min"), F.max("v").alias("max"))
    return made.select(*series, F.unix_seconds("window.start").alias("t"), "v", "min", "max")


def totals(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Exporter-minute totals of a flow stream."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = rows.groupBy("exporter", F.window("ts", "1 minute")).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("flows"))
    return made.select("exporter", F.unix_seconds("window.start").alias("t"), "bytes", "packets", "flows")


def statuses(stream: DataFrame, down_after: int = 3) -> DataFrame:
    """device_id, sample_id, status: device_status over a stream of polls."""

    def step(key: int, held: tuple | None, rows: list) -> tuple[list[tuple], tuple]:
        state = Status(down_after, *(held or ()))
        return [(key, n, state.step(*x)) for n, *x in rows], (state.status, state.fails, state.oks)

    inputs = ["sample_id", "reachable", "degraded", "maintenance", "upstream_down"]
    return by_arrival(stream, "device_id", ["ts", "sample_id"], inputs, "device_id long, sample_id long, status string", "status string, fails int, oks int", step)


def alerts(stream: DataFrame, again: float = 1800) -> DataFrame:
    """Alerts (dedup_key, n and their state) that a micro-batch of actions has changed: upsert_alerts over a stream, the newest row of each counts."""
    def step(key: str, held: tuple | None, rows: list) -> tuple[list[tuple], tuple]:
        alert = Alert(again)
        if held is not None:
            alert.restore(held)
        made = {}
        for x in rows:
            last = alert.step(*[None if v != v else v for v in x])
            made[last[0]] = last
        made.pop(0, None)
        return [(key, *x) for x in made.values()], last

    return by_arrival(with_texts(stream), "dedup_key", ["t", "n"], ["t", *ACTION[2:]], "dedup_key string, n int, " + UPSERTED.split(", ", 1)[1], UPSERTED, step, "update")


class Ordered:
    """An Alert that in_order() runs; its state is one part."""

    def __init__(self, again: float) -> None:
        self.alert = Alert(again)

    def step(self, t: float, n: int, *action) -> list[tuple]:
        held = self.alert.step(t, *action)
        return [(t, n, *held)] if held[0] else []

    def advance(self, t: float) -> list[tuple]:
        return []

    def due(self) -> float | None:
        return None

    def dump(self) -> list[tuple]:
        return [(0, *self.alert.held())]

    def load(self, held: list[tuple]) -> None:
        if held:
            self.alert.restore(held[0][1:])


ACTION_ROW = "t double, n long, action string, severity int, source string, root_cause string, title string, detail string, impact string"


def acted_alerts(events: DataFrame, operators: DataFrame, again: float = 1800, late: str = "0 seconds") -> DataFrame:
    """dedup_key, t, seq and UPSERTED: the alert after each action, of two streams in one state: what monitors raise and resolve, and what operators acknowledge and end.

    Each stream has its own watermark; actions go through the fold in the order of their time, once both streams have passed it. An action behind
    the watermark is dropped and counted (late_rows).
    """
    both = event_time(with_texts(events), late=late).unionByName(event_time(with_texts(operators), late=late))
    return in_order(both, "dedup_key", ACTION_ROW, "dedup_key string, t double, seq long, " + UPSERTED, lambda key: Ordered(again))


def ended(stream: DataFrame, again: float = 1800, late: str = "0 seconds") -> DataFrame:
    """family and ENDED: ended_alerts over a stream; limits are event-time timers, as many as a family has alerts."""
    return in_order(event_time(stream, late=late), "family", FAMILY_ROW, "family long, " + ENDED, lambda key: Family(key, again))


def finding_feed(stream: DataFrame) -> DataFrame:
    """finding_changes over a stream of alert states: the state keeps what was last reported of each alert. deliver() is its sink."""
    columns = [f for f in stream.schema.fields if f.name not in ("id", "seq")]
    facts = F.xxhash64(*[f.name for f in columns])
    out = "id long, seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", change string"

    def step(key: int, held: tuple | None, rows: list) -> tuple[list[tuple], tuple]:
        was, then = held or (None, None)
        out = []
        for seq, state, now, *facts in rows:
            live = state != "resolved"
            change = "opened" if live and was in (None, "resolved") else "resolved" if not live and was not in (None, "resolved") else "changed" if live and now != then else None
            was, then = state, now
            if change:
                out.append((key, seq, *facts, change))
        return out, (was, then)

    return by_arrival(stream.withColumn("digest", facts), "id", ["seq"], ["seq", "state", "digest", *[f.name for f in columns]], out, "state string, facts long", step)


class Recent:
    """Counts a key's rows of the last `span` seconds at each row; one exactly so old doesn't count. The state is the times that still count."""

    def __init__(self, span: float, least: int) -> None:
        self.span, self.least, self.times = span, least, []

    def step(self, t: float, n: int) -> list[tuple]:
        self.times = [(k, x) for k, x in self.times if x > t - self.span] + [(n, t)]
        return [(n, len(self.times))] if len(self.times) >= self.least else []

    def advance(self, t: float) -> list[tuple]:
        self.times = [(k, x) for k, x in self.times if x > t - self.span]
        return []

    def due(self) -> float | None:
        return self.times[-1][1] + self.span if self.times else None

    def dump(self) -> list[tuple]:
        return list(self.times)

    def load(self, held: list[tuple]) -> None:
        self.times = sorted(held, key=lambda x: (x[1], x[0]))


def bursts(stream: DataFrame, key: str, span: float, least: int, late: str = "0 seconds") -> DataFrame:
    """key, n, recent: sliding_count over a stream (key, t in seconds, n), each n once: a row delivered twice within the lateness counts once.

    A row that comes more than `late` behind the newest row of an earlier micro-batch is dropped and counted (late_rows).
    """
    rows = event_time(stream, late=late).dropDuplicatesWithinWatermark(["n"])
    return in_order(rows, key, "t double, n long", f"{key} long, n long, recent int", lambda _: Recent(span, least))


def appended(stream: DataFrame, series: list[str], late: str = "1 millisecond") -> DataFrame:
    """series, t, v, arrival: rows (series, t seconds, arrival, v) that the append rules keep; of equal times the one of the last arrival counts.

    NaN and infinite values go, and rows older than their series' newest. The watermark stands `late` before the hour of the newest row: a row of an earlier hour than the
    newest one of an earlier micro-batch is dropped and counted; in one micro-batch no row is too late for another series.
    """
    rows = stream.withColumn("ts", F.timestamp_seconds(F.floor(F.col("t") / 3600) * 3600)).withWatermark("ts", late)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in series]).alias("series")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(key: str, held: tuple | None, rows: list) -> tuple[list[tuple], tuple]:
        top, out = held[0] if held else None, []
        for row in rows:
            t, v = row[-3], row[-2]
            if v == v and abs(v) != float("inf") and (top is None or t >= top):
                top = t
                out.append(tuple(row))
        return out, (top,)

    made = rows.select("ts", *series, "t", "v", "arrival", key)
    out = ", ".join(f"{c} {kinds[c]}" for c in series) + f", t {kinds['t']}, v {kinds['v']}, arrival {kinds['arrival']}"
    return by_arrival(made, "series", ["arrival"], [*series, "t", "v", "arrival"], out, "top long", step, ts="ts")


def stale(stream: DataFrame, interval: int, cycles: int = 5, late: str = "0 seconds") -> DataFrame:
    """device_id, last_poll, status unknown: devices without a poll for more than `cycles` intervals, found by an event-time timer."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get[0]
            held.remove()
            yield pd.DataFrame({"device_id": [k[0]], "last_poll": [last], "status": ["unknown"]})
            return
        last = max([int(rows["t"].max()) for rows in batches if len(rows)] + ([held.get[0]] if held.exists else []))
        held.update((last,))
        held.setTimeoutTimestamp(max((last + cycles * interval) * 1000 + 1, held.getCurrentWatermarkMs() + 1))

    rows = stream.select("device_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("t", F.unix_seconds("ts"))
    return rows.groupBy("device_id").applyInPandasWithState(fold, "device_id long, last_poll long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def thresholds(stream: DataFrame, enter: float, leave: float, cycles: int) -> DataFrame:
    """device_id, sample_id, on: the same rule as in batch, its run count and state kept between batches."""

    def step(key: int, held: tuple | None, rows: list) -> tuple[list[tuple], tuple]:
        state = Threshold(enter, leave, cycles, *(held or (0, False)))
        return [(key, n, state.step(v)) for n, v in rows], (state.run, state.on)

    return by_arrival(stream, "device_id", ["ts", "sample_id"], ["sample_id", "v"], "device_id long, sample_id long, on boolean", "run int, on boolean", step)


def suppress(stream: DataFrame, gap: float) -> DataFrame:
    """key, event_id of rows at least `gap` seconds after the last one let through, also across batches."""

    def step(key: str, held: tuple | None, rows: list) -> tuple[list[tuple], tuple]:
        last, out = (held[0] if held else None), []
        for t, n in rows:
            if last is None or t - last >= gap:
                last = t
                out.append((key, n))
        return out, (last,)

    return by_arrival(stream, "key", ["t", "event_id"], ["t", "event_id"], "key string, event_id long", "last double", step)
