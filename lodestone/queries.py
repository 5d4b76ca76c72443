"""All queries of the core, on the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import breadth, composites, evaluation, events, knowledge, recommend, relational, stateful

_MODULES = (events, relational, recommend, knowledge, stateful, composites, breadth, evaluation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
