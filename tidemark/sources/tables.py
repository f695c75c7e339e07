"""Reading and writing tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BOM = "﻿"


def detect_format(path: str, fmt: str = "auto") -> str:
    """``parquet`` for .parquet/.pq, otherwise csv, unless stated."""
    if fmt != "auto":
        return fmt
    return "parquet" if path.lower().rstrip("/").endswith((".parquet", ".pq")) else "csv"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    sep: str = ",",
    encoding: str = "UTF-8",
    schema: T.StructType | str | None = None,
    order_by: Sequence[str] | None = None,
    limit: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Open a table; CSV columns stay text unless a schema is given.

    ``multi_line`` reads CSV records with line breaks inside quotes as one. Such a file
    can't be split: each is read by one task, so keep the files of a large table small.

    ``limit`` needs ``order_by``: "the first n" means nothing without an order.
    """
    fmt = detect_format(path, fmt)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
        df = (reader.schema(schema) if schema else reader).csv(path)
        first = df.columns[0]
        if first.startswith(BOM):
            df = df.withColumnRenamed(first, first.lstrip(BOM))
    elif fmt == "json":
        reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        df = (reader.schema(schema) if schema else reader).json(path)
    elif fmt == "orc":
        df = spark.read.orc(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if limit is None:
        return df
    if not order_by:
        raise ValueError("limit needs order_by")
    return df.orderBy(*order_by).limit(limit)


DRAWS = 1_000_000


def _draw(keys: Sequence[str], seed: int) -> Column:
    """A number below DRAWS from the md5 of the keys, which other engines repeat."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % DRAWS


def sample(df: DataFrame, frac: float, by: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Keep ``frac`` of the keys (or rows): the same key is always in or always out."""
    return df.filter(_draw(list(by) if by else df.columns, seed) < round(frac * DRAWS))


def sample_strata(df: DataFrame, stratum: str, fractions: dict, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Per-stratum keep rates; strata without a rate are left out."""
    rate = F.lit(0)
    for name, frac in fractions.items():
        rate = F.when(F.col(stratum) == name, F.lit(round(frac * DRAWS))).otherwise(rate)
    return df.filter(_draw(key, seed) < rate)


def land_bronze(df: DataFrame, path: str, source: str, batch_id: str, now: dt.datetime) -> None:
    """Append a batch unchanged, with ingest metadata, partitioned by batch."""
    stamped = df.withColumns(
        {
            "_source": F.lit(source),
            "_batch_id": F.lit(batch_id),
            "_ingested_at": F.lit(now).cast("timestamp_ntz"),
        }
    )
    stamped.write.mode("append").partitionBy("_batch_id").parquet(path)


def with_source_file(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with the file each came from."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_source_file"))


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write parquet in few, evenly sized files per partition.

    The rebalance hint shuffles by partition value and lets the adaptive planner
    split hot values by size and merge small ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt == "json":
        writer = df.write.mode("errorifexists").option("ignoreNullFields", False)
        # the default layout keeps milliseconds only
        writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option(
            "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
        ).json(path)
    elif fmt == "csv":
        df.write.mode("errorifexists").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def load_seed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV lookup with a declared schema; Spark broadcasts it while it stays small."""
    return spark.read.option("header", True).schema(schema).csv(path)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: table, position, name, type, nullable, table row count."""
    parts = []
    for name, df in tables.items():
        cols = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.nullable).alias("nullable"),
                )
                for i, f in enumerate(df.schema.fields, 1)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("table"), "row_count", F.inline(cols)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def observed_rows(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Attach row-count metrics that are filled by the next action."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *metrics)
