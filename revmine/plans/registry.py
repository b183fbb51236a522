"""Registry of named queries and their SQL oracles.

Each query is registered next to its DuckDB SQL so the pair stays in sync.
Column names and types are aliased/cast identically on both sides; floating
results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
BENCH: list[str] = []


def register(name: str, sql: str | None = None, bench: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (+ oracle SQL)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        if bench:
            BENCH.append(name)
        return fn

    return deco
