"""Projections, filters, predicates."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import project as pr
from tidemark.plans.registry import query

NAMES = [("O", "open"), ("F", "finished")]


@query(
    "b1_stage",
    """SELECT c_custkey AS customer_id, trim(c_name) AS customer_name, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE AS balance,
              trim(c_mktsegment) AS segment FROM customer""",
)
def _(t):
    spec = {
        "customer_id": ("c_custkey", "bigint"),
        "customer_name": ("c_name", "string"),
        "balance": ("c_acctbal", "decimal(18,2)"),
        "segment": ("c_mktsegment", "string"),
    }
    return pr.stage(t.customer, spec).withColumn("balance", F.col("balance").cast("double"))


@query("b2_star_except", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def _(t):
    return pr.star_except(t.lineitem, ["l_tax", "l_discount"])


@query("b3_star_replace", "SELECT * REPLACE (round(o_totalprice / 100, 4) AS o_totalprice) FROM orders")
def _(t):
    return pr.star_replace(t.orders, {"o_totalprice": F.round(F.col("o_totalprice") / 100, 4)})


@query(
    "b4_clean_orders",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus, o_totalprice, o_orderpriority
       FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 0
         AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '2000-01-01'
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1""",
)
def _(t):
    return pr.clean_orders(
        t.orders, "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice", ["O", "F"],
        ["o_orderdate", "o_orderkey"], "1996-01-01", "2000-01-01",
    )


@query(
    "b5_optional_filters",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    return (
        t.orders.transform(pr.when_set("F", lambda v: F.col("o_orderstatus") == v))
        .transform(pr.when_set(None, lambda v: F.col("o_orderpriority") == v))
        .select("o_orderkey", "o_orderstatus")
    )


@query(
    "b6_half_open_dates",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'""",
)
def _(t):
    keep = fx.date_range("o_orderdate", "1997-01-01", "1997-04-01")
    return t.orders.filter(keep).select("o_orderkey", "o_orderdate")


@query(
    "b7_not_in_nulls",
    """SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS
       (SELECT 1 FROM (SELECT DISTINCT nullif(o_orderpriority, '5-LOW') AS p FROM orders WHERE o_totalprice < 2000) k
        WHERE k.p = o.o_orderpriority)""",
)
def _(t):
    cheap = t.orders.filter("o_totalprice < 2000").select(fx.nullify("o_orderpriority", ["5-LOW"]).alias("p")).distinct()
    return pr.not_in(t.orders, cheap, "o_orderpriority", "p").select("o_orderkey", "o_orderpriority")


@query(
    "b8_bucketize",
    """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_band,
              count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(t):
    band = fx.bucketize("l_quantity", [10, 30], ["small", "medium", "large"])
    return t.lineitem.groupBy(band.alias("size_band")).agg(F.count("*").alias("n"))


@query(
    "b9_normalize_nulls",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
              coalesce(nullif(o_orderstatus, 'P'), 'UNKNOWN') AS o_orderstatus FROM orders""",
)
def _(t):
    df = pr.normalize_nulls(
        t.orders, {"o_orderpriority": ["4-NOT SPECIFIED"], "o_orderstatus": ["P"]}, {"o_orderstatus": "UNKNOWN"}
    )
    return df.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "b10_constraints",
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' AND r_name = 'ASIA'""",
)
def _(t):
    wide = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    global_rules = {"active": F.col("c_acctbal") >= 0, "not_excluded": F.col("c_mktsegment") != "MACHINERY"}
    persona = {"region_head": F.col("r_name") == "ASIA"}
    return pr.apply_constraints(wide, {**global_rules, **persona}).select("c_custkey", "n_name")


@query(
    "b11_map_codes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'other' END AS status_name
       FROM orders""",
)
def _(t):
    seed = t.spark.createDataFrame(NAMES, "code string, status_name string")
    return pr.map_codes(t.orders, "o_orderstatus", seed, "code", "status_name", "other").select(
        "o_orderkey", "status_name"
    )


@query(
    "b12_named_steps",
    """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000),
            yearly AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus FROM big)
       SELECT order_year, o_orderstatus, count(*) AS n FROM yearly GROUP BY ALL""",
)
def _(t):
    def big(df):
        return df.filter("o_totalprice > 250000")

    def yearly(df):
        return df.select(F.year("o_orderdate").alias("order_year"), "o_orderstatus")

    def counted(df):
        return df.groupBy("order_year", "o_orderstatus").agg(F.count("*").alias("n"))

    return pr.pipeline(t.orders, [big, yearly, counted])


@query("b13_require_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    return pr.require_columns(t.orders, ["o_orderkey", "o_custkey"]).select("o_orderkey", "o_custkey")
