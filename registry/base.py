"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lictor.functions.numeric import rounded
from registry.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the domain tables under its own name, with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return build

    return register


def round_columns(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Unrounded floating results, rounded so that the order of summation cannot show."""
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
