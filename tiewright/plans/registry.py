"""All queries on the driver's tables, with their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiewright.plans import aggregates, comparisons, network, pages, records, relations, reports, statistics, texts, volumes, windows

FAMILIES = (network, aggregates, windows, volumes, relations, statistics, texts, comparisons, records, pages, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
