"""Folds over the rows of each key in order, with a state that is small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Callable], added: str) -> DataFrame:
    """Adds the columns `added` (a schema string): what a fold over each key's rows in order gives for each row.

    start() makes a key's fold, a function of one row's inputs; it gives one value, or a tuple for several columns. Spark deals
    the rows by key and sorts them, and the fold goes on from batch to batch, so a task holds one batch and one state
    at a time, however many rows a key has. Null keys are one key.
    """
    new = StructType.fromDDL(added)
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list | None = None
        step: Callable = start()
        for rows in batches:
            if not len(rows):
                continue
            first = np.zeros(len(rows), bool)
            for k in keys:
                values = rows[k]
                same = (values == values.shift()) | (values.isna() & values.shift().isna())
                first |= ~same.fillna(False).to_numpy(bool)
            now = [rows[k].iat[0] for k in keys]
            first[0] = last is None or any(a != b and not (pd.isna(a) and pd.isna(b)) for a, b in zip(last, now))
            last = [rows[k].iat[-1] for k in keys]
            made = []
            for begins, *values in zip(first.tolist(), *[rows[c].tolist() for c in inputs]):
                if begins:
                    step = start()
                made.append(step(*values))
            columns = {names[0]: made} if len(names) == 1 else dict(zip(names, zip(*made)))
            yield rows.assign(**{c: list(v) for c, v in columns.items()})

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, StructType(df.schema.fields + new.fields))


class Gap:
    """Lets a value through that is at least `gap` above the last one let through, and every one that must."""

    def __init__(self, gap: float) -> None:
        self.gap, self.last = gap, None

    def step(self, t: float, must: bool = False) -> bool:
        ok = bool(must) or self.last is None or t - self.last >= self.gap
        if ok:
            self.last = t
        return ok
