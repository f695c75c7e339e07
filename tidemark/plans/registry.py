"""Registry of runnable queries over the standard tables, each with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.days import DAYS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Attribute access to the standard parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    @property
    def order_lines(self) -> DataFrame:
        """Lines with their orders. Orders grow with the lines, and their files say too little about their size in memory to broadcast them."""
        return self.lineitem.join(self.orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its independent check."""

    def wrap(fn):
        days = DAYS.get(name, ())
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = fn(Tables(spark, folder))
            return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in days}) if days else df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            if days:
                stamps = ", ".join(f'CAST("{c}" AS TIMESTAMP) AS "{c}"' for c in days)
                CHECK_SQL[name] = f"SELECT * REPLACE ({stamps}) FROM (\n{sql}\n) AS r"
            else:
                CHECK_SQL[name] = sql
        return fn

    return wrap
