"""Where the plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waybill.plans.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name`` with the SQL that gives the same rows."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        MODULES[name] = build.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return add
