"""How a query is put down: a function of (spark, sf_dir), and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back, for a frame that several branches of a plan use."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Book:
    """Collects the queries of a module."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, sql: str | None = None):
        def add(run):
            self.queries[run.__name__] = run
            if sql is not None:
                self.oracles[run.__name__] = sql
            return run

        return add
