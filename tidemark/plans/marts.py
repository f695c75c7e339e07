"""Composed marts over orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import money_sum, safe_div
from tidemark.operators.project import clean_orders


def daily_mart(orders: DataFrame, customers: DataFrame, statuses=("O", "F", "P")) -> DataFrame:
    """Clean orders, join segment, then revenue / count / AOV / share per day and segment.

    Two small aggregates share one shuffle key (the day), so the share needs no
    window over raw rows.
    """
    clean = clean_orders(
        orders, "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", list(statuses), ["o_orderdate"]
    )
    joined = clean.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    seg = joined.groupBy(F.col("o_orderdate").alias("order_day"), F.col("c_mktsegment").alias("segment")).agg(
        money_sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders")
    )
    day = seg.groupBy("order_day").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("_day_total"))
    out = seg.join(day, "order_day")
    return out.select(
        "order_day",
        "segment",
        "revenue",
        "n_orders",
        F.round(safe_div("revenue", "n_orders"), 4).alias("aov"),
        F.round(safe_div("revenue", "_day_total"), 6).alias("share"),
    )


def run_medallion(orders: DataFrame, customers: DataFrame, out: str, now) -> DataFrame:
    """Bronze landing, typed and de-duplicated silver, monthly gold; each layer is written once."""
    from tidemark.functions.columns import money, period
    from tidemark.operators.aggregate import build_aggregate
    from tidemark.operators.joins import star_join
    from tidemark.operators.project import stage
    from tidemark.operators.windows import dedup_latest
    from tidemark.sources.tables import land_bronze, write_table

    spark = orders.sparkSession
    # the same batch delivered twice must not change silver
    for batch in ("b1", "b1_retry"):
        land_bronze(orders, f"{out}/bronze", "orders", batch, now)
    spec = {
        "order_id": ("o_orderkey", "bigint"),
        "customer_id": ("o_custkey", "bigint"),
        "status": ("o_orderstatus", "string"),
        "amount": ("o_totalprice", "decimal(18,2)"),
        "order_ts": ("o_orderdate", "timestamp_ntz"),
        "batch": ("_batch_id", "string"),
    }
    silver = stage(spark.read.parquet(f"{out}/bronze"), spec)
    silver = dedup_latest(silver, ["order_id"], [F.desc("order_ts"), F.desc("batch")])
    write_table(silver.withColumn("order_year", F.year("order_ts")), f"{out}/silver", ["order_year"])
    fact = spark.read.parquet(f"{out}/silver").filter(F.col("status").isin("O", "F"))
    dim = customers.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    star = star_join(fact, {"customer_id": (dim.withColumn("sk", F.col("c_custkey")), "c_custkey", "sk")})
    star = star.join(dim, F.col("customer_id_key") == F.col("c_custkey"), "left")
    gold = build_aggregate(star, [period("order_ts", "month").alias("month"), "segment"], {"revenue": money("amount")})
    gold = gold.withColumn("revenue", F.col("revenue").cast("double"))
    write_table(gold, f"{out}/gold")
    return spark.read.parquet(f"{out}/gold")
