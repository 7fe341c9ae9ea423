"""Queries over the given tables, each with the SQL that DuckDB runs for comparison."""

from . import alerts, endpoints, flow, inventory, logs, metrics, probes, reports, snapshots, sources, state, topology  # noqa: F401, I001
from . import streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
