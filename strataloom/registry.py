"""All registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.functions.runtime import share_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with its SQL twin if there is one."""

    def register(make: Callable[[Tables], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = lambda spark, folder: make(Tables(share_package(spark), folder))
        if sql:
            ORACLES[key] = sql
        return make

    return register


from strataloom.plans import load  # noqa: E402

load()
