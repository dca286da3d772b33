"""Queries by name, each with the SQL that a second engine runs to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def literal(spark: SparkSession, values: str) -> DataFrame:
    """A small table from a VALUES text, which both engines read: ``(VALUES ...) AS t(a, b)``."""
    return spark.sql(f"SELECT * FROM {values}")
