"""Registered queries and the views that they and their oracles read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import VIEWS

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_USED = re.compile(r"\bv_\w+")
_FROM = re.compile(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", re.IGNORECASE)


class Data:
    """Tables and views of one folder: data("events"), data("v_devices")."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views, without names in the catalog."""
        text = with_views(text)
        names = {m.group(2).lower() for m in _FROM.finditer(text)}
        return self.spark.sql(_FROM.sub(r"\1 {\2}", text), **{n: self(n) for n in names})


def with_views(text: str) -> str:
    """Puts the views that a statement uses, and those that they use, before it as common table expressions."""
    found: list[str] = []

    def need(sql: str) -> None:
        for name in dict.fromkeys(_USED.findall(sql)):
            if name in VIEWS and name not in found and f"{name} as (" not in text:
                need(VIEWS[name])
                if name not in found:
                    found.append(name)

    need(text)
    heads = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in found)
    text = text.strip()
    m = re.match(r"with\s+(recursive\s+)?", text, re.IGNORECASE)
    if not heads:
        return text
    if m:
        return f"with {m.group(1) or ''}{heads}, {text[m.end() :]}"
    return f"with {heads} {text}"


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers fn(data) -> DataFrame under a name, with its DuckDB SQL."""

    def register(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
