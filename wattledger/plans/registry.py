"""Registry of queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL_TWINS: dict[str, str] = {}


def in_utc(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one and the UTC clock, on which the plans' texts are written; the given
    session keeps its own zone."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows. It runs on the UTC clock."""

    def add(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(in_utc(spark), folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL_TWINS[function.__name__] = sql
        return function

    return add
