"""Name -> query and name -> check SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from catalog.fixtures import World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}
AREAS = ("sources", "labels", "features", "texts", "evaluation", "splits", "scores", "models", "flagship")


def query(name: str, sql: str | None = None):
    """Register a query over the derived world, with its check SQL if it has one."""

    def add(build: Callable[[World], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: build(World(spark, folder))
        if sql is not None:
            CHECK_SQL[name] = sql
        return build

    return add


def load_all() -> None:
    for area in AREAS:
        import_module(f"catalog.{area}")

