"""Queries by name, each with the SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "encode_pseudobulk_topfraction"


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from ranklane.plans import contexts, encoding, mapping, reports, resampling, runs, statistics, vectors  # noqa: E402, F401  they register their queries
