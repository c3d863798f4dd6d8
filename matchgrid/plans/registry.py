"""All tracking queries with their oracle SQL.

A query module registers its queries with ``@query(name, oracle, *views)``;
``views`` names the adapter tables that the oracle text uses.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from matchgrid.sources.adapters import oracle as with_views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["scalars", "joins", "aggregates", "windows", "graphs", "matching", "live", "media", "annotations", "scenes", "fields", "files"]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[name] = f
        if oracle is not None:
            _oracles[name] = with_views(oracle, *views)
        return f

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"matchgrid.plans.{name}")


def queries() -> dict[str, Query]:
    load()
    return _queries


def oracle_sql() -> dict[str, str]:
    load()
    return _oracles
