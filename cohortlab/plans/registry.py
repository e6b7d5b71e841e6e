"""Registry of named queries: each has a Spark builder and (optionally) DuckDB oracle SQL."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortlab.plans.oracle import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        text = with_views(views or [], sql) if sql is not None else None
        REGISTRY[name] = Query(name, fn, text, (fn.__doc__ or "").strip())
        return fn
    return deco
