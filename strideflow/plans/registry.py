"""Collects the registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its optional SQL."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: fn(tune(spark), sf)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"{__package__}.{name}")


MODULES = ["frame_queries", "vector_queries", "join_queries", "metric_queries", "contact_queries", "candidate_queries", "table_queries", "stream_queries", "source_queries"]
