"""Where queries are registered together with their check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.oracle import assemble
from tidewatch.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the final SELECT over the oracle's blocks."""

    def register(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = assemble(sql)
        return run

    return register
