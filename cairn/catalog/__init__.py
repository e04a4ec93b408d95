"""Registered queries: each names a Spark computation and, where SQL can say it, the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cairn.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional equivalent SQL text."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_MODULES: tuple[str, ...] = (
    "selection",
    "adjustment",
    "tables",
    "coordinates",
    "accuracy",
    "models",
    "ingest",
    "positions",
    "network",
)


def load() -> None:
    for module in _MODULES:
        import_module(f"cairn.catalog.{module}")
