"""Registered queries and the DuckDB text that each must agree with."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def load() -> None:
    package = importlib.import_module("shootlake.plans.queries")
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"shootlake.plans.queries.{module.name}")
