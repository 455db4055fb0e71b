"""Every registered query of the listing engine with its DuckDB oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where DuckDB can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    from . import q_audit, q_frontier, q_hedonic, q_induction, q_market, q_merge, q_rules, q_scalars, q_search, q_sources, q_state, q_stats, q_values, q_versions  # noqa: F401


load()
