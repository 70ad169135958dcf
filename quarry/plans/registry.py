"""Registry of named queries: Spark job + DuckDB oracle SQL.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Modules under ``quarry.plans`` add entries with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # Importing the modules fills the registry.
    import importlib
    for mod in ("q_intake", "q_text", "q_summary", "q_reply", "q_cache", "q_quality",
                "q_feedback", "q_reqlog", "q_stream"):
        try:
            importlib.import_module(f"quarry.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"quarry.plans.{mod}":
                raise
    return QUERIES
