"""Named queries, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arkose.shipping import ship


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers f(t) under its name; t gives the tables of a folder."""

        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(Tables(spark, sf_dir))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add


class Tables:
    """The Parquet tables of a folder, read when asked for: t.orders, t.lineitem, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """SQL over the named tables, written {orders}; no view is registered."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def money(column: str) -> Column:
    """A double with two decimals as a decimal: its sum does not depend on the order."""
    return F.col(column).cast("decimal(18,2)")


def as_sum(column: Column) -> Column:
    return F.sum(column).cast("double")


def mean(column: Column) -> Column:
    """An average whose value does not depend on the order of the rows."""
    return F.sum(column).cast("double") / F.count(column)
