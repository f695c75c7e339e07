"""Incremental loads over plain tables: slices, upserts, syncs, backfills, versions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import hash_diff, micros


def incremental_slice(src: DataFrame, target: DataFrame, col: str, lookback: str) -> DataFrame:
    """Source rows newer than the target's maximum minus a look-back.

    The bound is a literal, so it prunes files and partitions at the source.
    """
    top = target.agg(F.max(col).alias("m")).first()["m"]  # one value
    if top is None:
        return src
    return src.filter(F.col(col) > F.lit(top) - F.expr(f"INTERVAL {lookback}"))


def upsert(target: DataFrame, src: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key; the rest stays."""
    return target.join(src.select(*key), list(key), "left_anti").unionByName(src.select(*target.columns))


def sync(target: DataFrame, src: DataFrame, key: Sequence[str], on_missing: str = "hard") -> DataFrame:
    """Full sync: keys absent at the source are deleted or marked ``is_deleted``."""
    fresh = src.select(*[c for c in target.columns if c != "is_deleted"])
    if on_missing == "hard":
        return fresh
    gone = target.join(src.select(*key), list(key), "left_anti").withColumn("is_deleted", F.lit(True))
    return fresh.withColumn("is_deleted", F.lit(False)).unionByName(gone)


def overwrite_partitions(df: DataFrame, path: str, col: str) -> None:
    """Replace only the partitions present in ``df``; hot partitions are split over tasks."""
    (
        df.hint("rebalance", col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(col)
        .parquet(path)
    )


def replace_window(target: DataFrame, src: DataFrame, col: str, start: Column, end: Column) -> DataFrame:
    """Delete and reinsert a half-open window."""
    inside = (F.col(col) >= start) & (F.col(col) < end)
    return target.filter(~F.coalesce(inside, F.lit(False))).unionByName(src.filter(inside))


def backfill(fn: Callable[[str, str], DataFrame], path: str, col: str, start: str, end: str) -> None:
    """Recompute [start, end) with ``fn`` and overwrite just its partitions."""
    made = fn(start, end)
    overwrite_partitions(made.filter((F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end))), path, col)


def detect_changes(target: DataFrame, src: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """insert / update / delete / same per key from row fingerprints."""
    a = target.select(*key, hash_diff(cols).alias("_a"))
    b = src.select(*key, hash_diff(cols).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete")
        .when(F.col("_a") != F.col("_b"), "update").otherwise("same")
    )
    return a.join(b, list(key), "full").select(*key, change.alias("change"))


def split_late(df: DataFrame, event: str, load: str, allowed_hours: float) -> DataFrame:
    """Delay per row and whether it is on time, inside the look-back or beyond it."""
    hours = (micros(load) - micros(event)) / F.lit(3.6e9)
    kind = F.when(hours <= 0, "on_time").when(hours <= allowed_hours, "within_lookback").otherwise("beyond_lookback")
    return df.withColumn("delay_hours", hours).withColumn("lateness", kind)


def suggested_lookback(df: DataFrame, event: str, load: str) -> DataFrame:
    """Largest observed delay and the look-back to cover it (1.5 times)."""
    hours = (micros(load) - micros(event)) / F.lit(3.6e9)
    return df.agg(F.max(hours).alias("max_delay_hours"), (F.max(hours) * 1.5).alias("lookback_hours"))


def resume(batches: DataFrame, ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    """Batches that no ledger row marks as done."""
    return batches.join(ledger.filter("status = 'done'").select(*key), list(key), "left_anti")


def append_ledger(spark: SparkSession, path: str, rows: Sequence[tuple], schema: str) -> None:
    """Append run or batch records; each append is its own small file."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


VERSION_SCHEMA = "version string, location string, published_at timestamp_ntz"


def publish(df: DataFrame, base: str, version: str, now: dt.datetime) -> None:
    """Write a complete new version, then switch to it by one ledger append.

    Readers see the old version until the switch; nothing is overwritten.
    """
    location = f"{base}/data/{version}"
    df.write.mode("errorifexists").parquet(location)
    append_ledger(df.sparkSession, f"{base}/versions", [(version, location, now)], VERSION_SCHEMA)


def rollback(spark: SparkSession, base: str, version: str, now: dt.datetime) -> None:
    """Point readers back to an already published version."""
    rows = spark.read.parquet(f"{base}/versions").filter(F.col("version") == version).limit(1).collect()
    if not rows:
        raise ValueError(f"version {version} was never published")
    append_ledger(spark, f"{base}/versions", [(version, rows[0]["location"], now)], VERSION_SCHEMA)


def current(spark: SparkSession, base: str) -> DataFrame:
    """The version readers should see."""
    ledger = spark.read.parquet(f"{base}/versions")
    location = ledger.agg(F.max_by("location", "published_at").alias("l")).first()["l"]
    return spark.read.parquet(location)
