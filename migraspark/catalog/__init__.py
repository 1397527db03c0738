"""Every operator as a query over the test tables, with the SQL that cross-checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from migraspark.session import prepare_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "relational",
    "workload",
    "reconcile",
    "generate",
    "conform",
    "io",
    "history",
    "corpus",
    "checks",
    "progress",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory name, with its SQL where SQL can express it."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare_session(spark), folder)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        importlib.import_module(f"migraspark.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
