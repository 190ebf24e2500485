"""Named queries and, where SQL can express them, their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlife.sources.sample_tables import SampleTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``function(tables)`` under ``name`` with an optional oracle."""

    def add(function: Callable[[SampleTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(SampleTables(spark, folder))

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add
