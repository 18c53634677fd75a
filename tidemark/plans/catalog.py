"""The registered queries over the test tables, each with its DuckDB counterpart where SQL can say it.

Queries run over whole tables. Results are rounded where engines add up in another order.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def discover() -> None:
    """Import every module of queries beside this one."""
    package = import_module("tidemark.plans")
    for m in pkgutil.iter_modules(package.__path__):
        if m.name.endswith("_queries"):
            import_module(f"tidemark.plans.{m.name}")
