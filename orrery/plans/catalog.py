"""The registered queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import feature_queries, preparation, ranking_queries, statistics_queries

MODULES = (preparation, ranking_queries, statistics_queries, feature_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name → callable of (spark, folder)."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name → DuckDB SQL over the same tables."""
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
