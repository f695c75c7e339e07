"""Incremental loads."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import loads as ld
from tidemark.plans import marts
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum
from tidemark.session import new_path

OLD = "o_orderdate < TIMESTAMP '2001-01-01'"


def target(t):
    """The warehouse copy: orders before 2001, finished ones with a stale price."""
    stale = F.when(F.col("o_orderstatus") == "F", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    df = t.orders.filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return df.select("o_orderkey", "o_orderstatus", stale.alias("o_totalprice"), "o_orderdate")


def src(t):
    """The source: open and finished orders of today."""
    return t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(
    "n1_incremental_slice",
    f"""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE {OLD}) - INTERVAL 3 DAY""",
)
def _(t):
    return ld.incremental_slice(t.orders, target(t), "o_orderdate", "3 DAYS").select("o_orderkey", "o_orderdate")


TARGET = f"t AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE {OLD})"
SOURCE = "s AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P')"


@query(
    "n2_upsert",
    f"""WITH {TARGET}, {SOURCE} SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""",
)
def _(t):
    return ld.upsert(target(t), src(t), ["o_orderkey"])


@query("n3_sync_hard", f"WITH {SOURCE} SELECT * FROM s")
def _(t):
    return ld.sync(target(t), src(t), ["o_orderkey"])


@query(
    "n3_sync_soft",
    f"""WITH {TARGET}, {SOURCE} SELECT *, false AS is_deleted FROM s UNION ALL SELECT *, true FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""",
)
def _(t):
    return ld.sync(target(t), src(t), ["o_orderkey"], "soft")


def yearly(t, df):
    return df.withColumn("order_year", F.year("o_orderdate"))


@query(
    "n4_overwrite_partitions",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n, {msum("CASE WHEN year(o_orderdate) = 1999 AND o_orderstatus = 'F' THEN 1 ELSE o_totalprice END")} AS v FROM orders GROUP BY 1""",
)
def _(t):
    path = new_path(t.spark, "dyn")
    base = yearly(t, t.orders)
    ld.overwrite_partitions(base, path, "order_year")
    fixed = F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).otherwise(F.col("o_totalprice"))
    ld.overwrite_partitions(base.filter("order_year = 1999").withColumn("o_totalprice", fixed), path, "order_year")
    return t.spark.read.parquet(path).groupBy("order_year").agg(F.count("*").alias("n"), fx.money_sum("o_totalprice").alias("v"))


@query(
    "n5_replace_window",
    f"""WITH {TARGET}, {SOURCE} SELECT * FROM t WHERE NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01')
        UNION ALL SELECT * FROM s WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'""",
)
def _(t):
    a, b = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-07-01").cast("timestamp_ntz")
    return ld.replace_window(target(t), src(t), "o_orderdate", a, b)


@query(
    "n6_backfill_range",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n FROM orders WHERE year(o_orderdate) NOT IN (1997, 1998) OR o_orderstatus <> 'P' GROUP BY 1""",
)
def _(t):
    path = new_path(t.spark, "backfill")
    ld.overwrite_partitions(yearly(t, t.orders), path, "order_year")
    ld.backfill(lambda a, b: yearly(t, t.orders.filter("o_orderstatus <> 'P'")), path, "order_year", 1997, 1999)
    return t.spark.read.parquet(path).groupBy("order_year").agg(F.count("*").alias("n"))


@query(
    "n7_detect_changes",
    f"""WITH {TARGET}, {SOURCE} SELECT o_orderkey, CASE WHEN t.o_orderstatus IS NULL THEN 'insert' WHEN s.o_orderstatus IS NULL THEN 'delete' WHEN t.o_totalprice <> s.o_totalprice THEN 'update' ELSE 'same' END AS change
        FROM t FULL JOIN s USING (o_orderkey)""",
)
def _(t):
    return ld.detect_changes(target(t), src(t), ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderdate"])


def loaded(t):
    df = t.order_lines
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate")


HOURS = "(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9"


@query(
    "n8_split_late",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {HOURS} AS delay_hours, CASE WHEN {HOURS} <= 0 THEN 'on_time' WHEN {HOURS} <= 720 THEN 'within_lookback' ELSE 'beyond_lookback' END AS lateness
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    return ld.split_late(loaded(t), "o_orderdate", "l_shipdate", 720).drop("o_orderdate", "l_shipdate")


@query(
    "n8_suggested_lookback",
    f"SELECT max({HOURS}) AS max_delay_hours, max({HOURS}) * 1.5::DOUBLE AS lookback_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    return ld.suggested_lookback(loaded(t), "o_orderdate", "l_shipdate")


@query(
    "n9_resume_batches",
    """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' OR month(o_orderdate) = 12""",
)
def _(t):
    path = new_path(t.spark, "ledger")
    batches = t.orders.select(fx.period("o_orderdate", "month").alias("month")).distinct()
    status = F.when(F.month("month") == 12, "failed").otherwise("done")
    batches.filter("month < DATE '1996-01-01'").withColumn("status", status).write.mode("append").parquet(path)
    return ld.resume(batches, t.spark.read.parquet(path), ["month"])


@query("n10_publish_versions", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    base = new_path(t.spark, "mart")
    ld.publish(t.orders, base, "v1", dt.datetime(2024, 1, 1))
    ld.publish(t.orders.filter("o_orderstatus = 'F'"), base, "v2", dt.datetime(2024, 1, 2))
    ld.rollback(t.spark, base, "v1", dt.datetime(2024, 1, 3))
    return ld.current(t.spark, base).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "n11_medallion_run",
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_mktsegment AS segment, {msum('o_totalprice')} AS revenue, count(*) AS n_rows
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2""",
)
def _(t):
    out = new_path(t.spark, "medallion")
    return marts.run_medallion(t.orders, t.customer, out, dt.datetime(2024, 1, 1))
