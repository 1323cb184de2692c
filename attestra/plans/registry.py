"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of the evaluation engine."""
    import attestra.plans.files  # noqa: F401
    import attestra.plans.queries  # noqa: F401
    import attestra.plans.rules  # noqa: F401

    return QUERIES, ORACLES
