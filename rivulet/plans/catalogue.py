"""All queries of the reference operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, impact, records, relational, streams

_ALL = events.QUERIES | relational.QUERIES | records.QUERIES | streams.QUERIES | impact.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, (_, sql) in _ALL.items() if sql}
