"""Folds over the rows of a key in a stream: in order of arrival, or in event-time order behind the watermark."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk(stream: DataFrame) -> DataFrame:
    """Sets the state store that these folds need: RocksDB, whose state may be larger than memory."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream


def table(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    """Rows as a frame whose numbers keep their types beside nulls."""
    kinds = {"long": "Int64", "integer": "Int32", "double": "Float64", "boolean": "boolean"}
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    return pd.DataFrame({f.name: pd.Series(list(c), dtype=kinds.get(f.dataType.typeName(), object)) for f, c in zip(schema.fields, columns)})


#: Keys are dealt over so many buckets. A bucket is one group of the stream and one entry of its state, so what a group costs (calls of Python and of the
#: state store, milliseconds) doesn't grow with the keys; memory holds one bucket's keys at a time.
BUCKETS = 2048


def bucketed(stream: DataFrame, key: str) -> DataFrame:
    """The stream with `_bucket`, the bucket of its key."""
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))


def plain(rows: pd.DataFrame, schema: StructType, names: list[str]) -> Iterator[tuple]:
    """Rows as tuples of plain values; a column of whole numbers with nulls comes as one of doubles."""
    columns = []
    for c in names:
        values, kind = rows[c].tolist(), schema[c].dataType.typeName()
        if kind in ("long", "integer") and rows[c].dtype.kind not in "iu":
            values = [None if v is None or v != v else int(v) for v in values]
        columns.append(values)
    return zip(*columns)


#: Rows of an entry of a packed list, and of a batch that a fold gives.
PACK = 10_000


def packed(rows: list[tuple]) -> list[tuple]:
    """Rows of plain values as few entries of a list state, whose every entry costs tens of microseconds."""
    return [(pickle.dumps(rows[i : i + PACK], pickle.HIGHEST_PROTOCOL),) for i in range(0, len(rows), PACK)]


def unpacked(state) -> Iterator[tuple]:
    for (entry,) in state.get():
        yield from pickle.loads(entry)


def count_late(late, n: int) -> None:
    """Adds to a bucket's count of rows that came behind the watermark."""
    if n:
        late.update(((late.get()[0] if late.exists() else 0) + n,))


class Arrivals(StatefulProcessor):
    """step(key, state or None, a key's rows of a micro-batch in order) -> rows, new state. The state is a bucket's list of keys, when they changed and their states, which may expire.

    With a column `ts`, rows that aren't above the watermark are dropped and counted.
    """

    def __init__(self, step: Callable, schema: StructType, key: str, order: list[str], inputs: list[str], state: str, out: StructType, ttl_ms: int | None = None, ts: str | None = None) -> None:
        self.step, self.schema, self.key, self.order, self.inputs, self.out, self.ttl, self.ts = step, schema, key, order, inputs, out, ttl_ms, ts
        self.state = StructType.fromDDL(f"_key {schema[key].dataType.simpleString()}, _at long, {state}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.folds = handle.getListState("folds", self.state, self.ttl)
        self.late = handle.getValueState("late", "n long") if self.ts else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows, ignore_index=True)
        if self.ts:
            known = batch[self.ts].astype("datetime64[ms]").astype("int64") > timerValues.getCurrentWatermarkInMs()
            count_late(self.late, int((~known).sum()))
            batch = batch[known]
            if not len(batch):
                return
        groups: dict = {}
        for k, *row in plain(batch.sort_values(self.order, kind="stable"), self.schema, [self.key, *self.inputs]):
            groups.setdefault(k, []).append(row)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        held = {k: (at, *state) for k, at, *state in self.folds.get() if not self.ttl or at + self.ttl > now}
        made: list[tuple] = []
        for k, some in groups.items():
            out, state = self.step(k, held[k][1:] if k in held else None, some)
            held[k] = (now, *state)
            made += out
        self.folds.put([(k, *state) for k, state in held.items()])
        if made:
            yield table(made, self.out)

    def close(self) -> None:
        pass


def by_arrival(stream: DataFrame, key: str, order: list[str], inputs: list[str], out: str, state: str, step: Callable, mode: str = "append", ttl_ms: int | None = None, ts: str | None = None) -> DataFrame:
    """A fold per key over rows of `inputs` whose state outlives the micro-batch. With ttl_ms a key's state goes once it hasn't changed for so long; with ts rows behind the watermark go."""
    schema = StructType.fromDDL(out)
    processor = Arrivals(step, stream.schema, key, order, inputs, state, schema, ttl_ms, ts)
    return on_disk(bucketed(stream, key)).groupBy("_bucket").transformWithStateInPandas(processor, schema, mode, "EventTime" if ts else "ProcessingTime" if ttl_ms else "None")


class Fold(Protocol):
    """What in_order() runs: dump() and load() turn it into a tuple and back, step() takes a row, advance() the time up to which all rows are known; both give rows. due() is when something happens by itself."""

    def step(self, *row) -> list[tuple]: ...
    def advance(self, t: float) -> list[tuple]: ...
    def due(self) -> float | None: ...
    def dump(self) -> list[tuple]: ...
    def load(self, held: list[tuple]) -> None: ...


class InOrder(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them; then they go through their key's fold in the order of their time.

    The state of a bucket is a list of the waiting rows and one of the folds' parts, both with their key, packed. A timer stands at the time of the first waiting row or
    the first due time of a fold, whatever comes first.
    """

    def __init__(self, start: Callable[..., Fold], schema: StructType, key: str, rows: str, out: str) -> None:
        self.start, self.schema, self.key = start, schema, key
        self.names, self.out = StructType.fromDDL(rows).names, StructType.fromDDL(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.parts = handle.getListState("parts", "rows binary")
        self.late = handle.getValueState("late", "n long")

    def _run(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows: dict = {}
        left: list[tuple] = []
        waited = False
        for r in unpacked(self.waiting):
            waited = True
            (left if math.floor(r[1] * 1000) > watermark else rows.setdefault(r[0], [])).append(r)
        for r in new:
            (left if math.floor(r[1] * 1000) > watermark else rows.setdefault(r[0], [])).append(r)
        held: dict = {}
        for k, *p in unpacked(self.parts):
            held.setdefault(k, []).append(tuple(p))
        made, parts, due = [], [], []
        for k in dict.fromkeys([*held, *rows, *(r[0] for r in left)]):
            fold = self.start(k)
            fold.load(held.get(k, []))
            for _, *r in sorted(rows.pop(k, []), key=lambda r: r[1:3]):
                made += [(k, *m) for m in fold.advance(r[0])]
                made += [(k, *m) for m in fold.step(*r)]
                if len(made) >= PACK:
                    yield table(made, self.out)
                    made = []
            made += [(k, *m) for m in fold.advance(watermark / 1000)]
            parts += [(k, *p) for p in fold.dump()]
            due.append(fold.due())
        for state, old, now in ((self.parts, held, parts), (self.waiting, waited, left)):
            if now:
                state.put(packed(now))
            elif old:
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [*(r[1] for r in left), *(t for t in due if t is not None)]
        if times:
            self.handle.registerTimer(max(math.ceil(min(times) * 1000), 1))
        if made:
            yield table(made, self.out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(None if v != v else v for v in r) for batch in rows for r in plain(batch, self.schema, [self.key, *self.names])]
        watermark = timerValues.getCurrentWatermarkInMs()
        fit = [r for r in new if math.floor(r[1] * 1000) > watermark]
        count_late(self.late, len(new) - len(fit))
        yield from self._run(fit, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._run([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, rows: str, out: str, start: Callable[..., Fold]) -> DataFrame:
    """A fold per key over rows (t in seconds first, a number for ties second) in the order of their time, whatever order they arrive in; the stream has a watermark on `ts`.

    start(key) makes a key's fold. Rows that come behind the watermark are dropped and counted (late_rows). out: the key, then what the fold gives.
    Only the columns that a fold reads go to Python: pandas holds no timestamp after the year 2262, and `ts` may lie there.
    """
    processor = InOrder(start, stream.schema, key, rows, out)
    dealt = bucketed(stream, key).select("_bucket", key, *processor.names)
    return on_disk(dealt).groupBy("_bucket").transformWithStateInPandas(processor, processor.out, "append", "EventTime")


def event_time(stream: DataFrame, t: str = "t", late: str = "0 seconds") -> DataFrame:
    """The stream with `ts`, the timestamp of its seconds, under a watermark."""
    return stream.withColumn("ts", F.timestamp_millis(F.floor(F.col(t) * 1000))).withWatermark("ts", late)


def late_rows(spark: SparkSession, query, checkpoint: str) -> int:
    """Rows that a finished query has dropped because they came behind its watermark: those that the folds have counted in their state, and those that Spark has dropped before."""
    own = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "late").load().agg(F.sum("value.n")).first()[0] or 0
    return own + sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
