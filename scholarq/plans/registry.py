"""Registry of named queries: Spark builder + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


REGISTRY: dict[str, Query] = {}
#: Queries that SQL cannot express.
WITHOUT_ORACLE: dict[str, Query] = {}


def query(name: str, sql: str | None, operators: str):
    def deco(fn):
        if name in REGISTRY or name in WITHOUT_ORACLE:
            raise ValueError(f"duplicate query {name}")
        (WITHOUT_ORACLE if sql is None else REGISTRY)[name] = Query(name, fn, sql, operators)
        return fn
    return deco
