"""Registered queries: each runs an operator over whole tables and may carry a SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "sequences", "selections", "aggregates", "spaces", "vectors", "walks", "inference", "evaluation", "plots", "storage",
)


def query(sql: str | None = None):
    """Register a function under its own name."""
    def register(fn: Query) -> Query:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load() -> None:
    for name in MODULES:
        import_module(f"terrane.catalog.{name}")
