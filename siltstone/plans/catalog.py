"""The registered queries: name, Spark plan and the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import analysis, conforming, details, evidence, gates, questions, revenue, splitting, timevalid, warehouse

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (revenue, questions, splitting, conforming, timevalid, warehouse, analysis, gates, evidence, details)


def queries() -> dict[str, Query]:
    """Every query of every plan module."""
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    """The SQL of the queries that have one."""
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
