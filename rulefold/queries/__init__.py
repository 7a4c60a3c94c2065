"""Catalogue of registered queries with their SQL counterparts.

Each query is a function (spark, folder) -> DataFrame over the tables in `folder`; `sql` states the same
result in plain SQL over views of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load_all() -> None:
    from rulefold.queries import (  # noqa: F401
        audits,
        derivations,
        libraries,
        memory,
        presentation,
        profiles,
        streams,
        tables,
        verification,
    )
