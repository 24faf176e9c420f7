"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.plans import changes, derive, enriched, graphs, more, problems, relational

_MODULES = [problems, relational, graphs, derive, changes, more, enriched]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """What a pattern's methods reach, and the effects there."""
    return derive.reaches(spark, folder, "Platform")
