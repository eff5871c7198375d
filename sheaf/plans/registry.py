"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables (or data Spark derives from them).  Compared outputs are flat,
every column aliased, doubles rounded to 6 places, counts as bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        text = sql() if callable(sql) else sql
        REGISTRY[name] = Query(name, fn, text, covers)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from sheaf.plans import queries_blocks, queries_ops, queries_stats, queries_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
