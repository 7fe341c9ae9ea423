"""Joins whose key many rows lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Left joins on `key`. Rows without a key match nothing and stay out of the shuffle, in which all of them would meet in one task."""
    known = rows.where(F.col(key).isNotNull())
    for other in others:
        known = known.join(other, key, "left")
    return known.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
