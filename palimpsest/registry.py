"""All registered queries and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import addresses, archive, integrity, links, reporting, urls

_MODULES = (links, urls, integrity, reporting, addresses, archive)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query callables by name, each taking the session and the folder of the tables."""
    return {name: call for module in _MODULES for name, call in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by name, for the queries that SQL can state."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
