"""Every registered query with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Modules whose import enters their queries.
MODULES = ("scalar_queries", "query_queries", "retrieval_queries", "search_queries", "engine_queries", "filter_queries", "join_queries", "graph_queries", "aggregate_queries", "catalog_queries")


def register(name: str, oracle: str | None = None):
    """Enter a query function, and the SQL for the same rows where there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """All queries and their SQL."""
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")
    return QUERIES, ORACLES
