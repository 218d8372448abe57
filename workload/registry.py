"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.blocking import spread

#: Tables of small rows that become wide catalogue rows and listings, and the key by which their rows are spread.
SPREAD = {"part": "p_partkey"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The test tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # a few bytes a row, so one task would read very many of them, and each is much work
        return spread(df, SPREAD[name]) if name in SPREAD else df


def query(name: str, sql: str | None = None):
    """Register a function Tables -> DataFrame under a name, with its SQL twin."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
