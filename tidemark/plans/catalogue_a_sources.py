"""Sources and sinks."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.plans.registry import TABLES, query
from tidemark.session import new_path
from tidemark.sources import tables as src
from tidemark.streaming import streams

NOW = dt.datetime(2024, 2, 1)


@query("a1_parquet_scan", "SELECT * FROM orders")
def _(t):
    return src.read_table(t.spark, t.path("orders"))


@query("a2_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = new_path(t.spark, "csv")
    t.customer.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return src.read_table(t.spark, path, "csv", sep=";", encoding="ISO-8859-1", schema=t.customer.schema)


@query(
    "a3_format_by_suffix",
    """SELECT 'parquet' AS format, (SELECT count(*) FROM orders) AS n_rows
       UNION ALL SELECT 'csv', (SELECT count(*) FROM orders)""",
)
def _(t):
    folder = new_path(t.spark, "suffix") + ".csv"
    src.write_report(t.orders, folder, "csv")
    out = None
    for path in (t.path("orders"), folder):
        one = src.read_table(t.spark, path).agg(
            F.lit(src.detect_format(path)).alias("format"), F.count(F.lit(1)).alias("n_rows")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("a4_first_n", "SELECT * FROM events ORDER BY ts, event_id LIMIT 100")
def _(t):
    return src.read_table(t.spark, t.path("events"), order_by=["ts", "event_id"], limit=100)


def _draw(key):
    return f"('0x' || substr(md5(concat_ws('|', {key}, 7)), 1, 15))::BIGINT % 1000000"


@query("a5_key_sample", f"SELECT * FROM events WHERE {_draw('user_id')} < 250000")
def _(t):
    return src.sample(t.events, 0.25, by=["user_id"], seed=7)


@query(
    "a5_stratified_sample",
    f"SELECT * FROM orders WHERE {_draw('o_orderkey')} < CASE o_orderstatus WHEN 'F' THEN 500000 WHEN 'O' THEN 100000 ELSE 0 END",
)
def _(t):
    return src.sample_strata(t.orders, "o_orderstatus", {"F": 0.5, "O": 0.1}, ["o_orderkey"], seed=7)


@query(
    "a6_pruned_scan",
    """SELECT l_orderkey, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R'""",
)
def _(t):
    keep = fx.date_range("l_shipdate", "1996-01-01", "1997-01-01") & (F.col("l_returnflag") == "R")
    return t.lineitem.filter(keep).select("l_orderkey", "l_extendedprice")


@query("a7_json_landing", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t):
    path = new_path(t.spark, "json")
    src.write_report(t.events, path, "json")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, _corrupt_record string"
    df = src.read_table(t.spark, path, "json", schema=schema)
    return df.select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "a8_bronze_landing",
    """SELECT o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'b1' ELSE 'b2' END AS batch_id,
              'erp' AS source, count(*) AS n_rows, TIMESTAMP '2024-02-01' AS ingested_at
       FROM orders GROUP BY ALL""",
)
def _(t):
    path = new_path(t.spark, "bronze")
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    src.land_bronze(t.orders.filter(cut), path, "erp", "b1", NOW)
    src.land_bronze(t.orders.filter(~cut), path, "erp", "b2", NOW)
    landed = src.with_source_file(t.spark, path)
    return landed.groupBy(
        "o_orderstatus",
        F.col("_batch_id").alias("batch_id"),
        F.col("_source").alias("source"),
        F.col("_ingested_at").alias("ingested_at"),
    ).agg(F.count("_source_file").alias("n_rows"))


@query(
    "a9_partitioned_sink",
    """SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders""",
)
def _(t):
    path = new_path(t.spark, "parts")
    df = t.orders.withColumn("order_year", F.year("o_orderdate"))
    src.write_table(df, path, ["order_year"], ["o_orderdate"])
    return t.spark.read.parquet(path).select("o_orderkey", "o_totalprice", "order_year")


@query(
    "a10_report_sink",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    path = new_path(t.spark, "report")
    src.write_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, "json")
    return t.spark.read.schema("o_orderpriority string, n long").json(path)


@query(
    "a11_seed_load",
    """SELECT r_name, count(*) AS n_nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def _(t):
    path = new_path(t.spark, "seed")
    src.write_report(t.region, path, "csv")
    seed = src.load_seed(t.spark, path, "r_regionkey int, r_name string")
    joined = t.nation.join(seed, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n_nations"))


@query("a12_stream_source", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    stream = streams.read_events_stream(t.spark, t.path("events"), t.events.schema)
    landed = streams.run_to_table(stream.select("event_id", "event_type"), "source")
    return landed.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "a13_inventory",
    "WITH n AS (" + "\nUNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS row_count FROM {n}" for n in TABLES)
    + """) SELECT table_name AS "table", CAST(column_index AS INTEGER) AS position, column_name AS "column", row_count
       FROM duckdb_columns() JOIN n ON t = table_name WHERE NOT internal""",
)
def _(t):
    inv = src.inventory({n: getattr(t, n) for n in TABLES})
    return inv.select("table", "position", "column", "row_count")
