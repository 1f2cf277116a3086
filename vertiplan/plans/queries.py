"""All queries of the planning engine, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vertiplan.plans import city, composed, network, regional, scalar

_ALL = scalar.QUERIES | network.QUERIES | regional.QUERIES | composed.QUERIES | city.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ALL.items() if text} | city.SQL
