"""Aggregations."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import aggregate as ag
from tidemark.plans import marts
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum


@query(
    "d1_group_aggregate",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {msum('l_quantity')} AS sum_qty, {msum('l_extendedprice')} AS sum_price,
               round({msum('l_extendedprice')} / count(*), 4) AS avg_price, max(l_discount) AS max_discount
        FROM lineitem GROUP BY ALL""",
)
def _(t):
    price = fx.money_sum("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        fx.money_sum("l_quantity").alias("sum_qty"),
        price.alias("sum_price"),
        F.round(price / F.count("*"), 4).alias("avg_price"),
        F.max("l_discount").alias("max_discount"),
    )


@query(
    "d2_conditional_aggregation",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year,
              count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_finished,
              CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS open_value
       FROM orders GROUP BY 1""",
)
def _(t):
    df = t.orders.withColumn("order_year", F.year("o_orderdate"))
    specs = {
        "n_finished": ("count", None, F.col("o_orderstatus") == "F"),
        "open_value": ("sum", fx.money("o_totalprice"), F.col("o_orderstatus") == "O"),
    }
    return ag.cond_agg(df, ["order_year"], specs).withColumn("open_value", F.col("open_value").cast("double"))


@query(
    "d3_filter_clause",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 300000) AS n_big,
              max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS max_urgent FROM orders GROUP BY 1""",
)
def _(t):
    return t.spark.sql(
        """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 300000) AS n_big,
                  max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS max_urgent
           FROM {orders} GROUP BY o_orderstatus""",
        orders=t.orders,
    )


@query(
    "d4_count_semantics",
    """SELECT o_orderstatus, count(*) AS n_rows, count(nullif(o_orderpriority, '5-LOW')) AS n_values,
              count(DISTINCT nullif(o_orderpriority, '5-LOW')) AS n_distinct FROM orders GROUP BY 1""",
)
def _(t):
    df = t.orders.withColumn("p", fx.nullify("o_orderpriority", ["5-LOW"]))
    return ag.count_semantics(df, "p", ["o_orderstatus"])


@query(
    "d5_safe_division",
    """SELECT l_returnflag, count(*) FILTER (WHERE l_tax = 0) AS n_zero,
              round(sum(CASE WHEN l_tax = 0 THEN 0 ELSE round(l_discount / l_tax, 6) END), 3) AS sum_or_zero
       FROM lineitem GROUP BY 1""",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count(F.when(fx.safe_div("l_discount", "l_tax").isNull(), 1)).alias("n_zero"),
        F.round(F.sum(F.round(fx.safe_div("l_discount", "l_tax", 0), 6)), 3).alias("sum_or_zero"),
    )


NEAR_DISTINCT = "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_distinct, true AS is_near FROM lineitem GROUP BY 1"


def near(t, approximate, error):
    """Exact counts, and whether the approximate ones lie within three relative errors."""
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_distinct"))
    close = F.abs(F.col("approx_distinct") - F.col("n_distinct")) <= 3 * error * F.col("n_distinct")
    return exact.join(approximate, "l_returnflag").select("l_returnflag", "n_distinct", close.alias("is_near"))


@query("d6_approx_distinct", NEAR_DISTINCT)
def _(t):
    return near(t, ag.approx_distinct(t.lineitem, ["l_returnflag"], "l_partkey"), 0.02)


@query("d6_mergeable_sketch", NEAR_DISTINCT)
def _(t):
    sketches = ag.distinct_sketch(t.lineitem, ["l_returnflag", "l_linestatus"], "l_partkey")
    return near(t, ag.merge_sketches(sketches, ["l_returnflag"]), 0.02)


@query(
    "d7_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90,
              round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
)
def _(t):
    out = ag.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("d7_percentiles_sketch")
def _(t):
    return ag.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9}, approx=True)


@query("d8_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 15")


@query(
    "d9_group_by_all",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
)
def _(t):
    return t.spark.sql(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL", orders=t.orders
    )


for _mode, _clause in {
    "rollup": "ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "CUBE (o_orderstatus, o_orderpriority)",
    "sets": "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
}.items():

    @query(
        f"d10_subtotals_{_mode}",
        f"""SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INTEGER) AS level,
                   count(*) AS n, {msum('o_totalprice')} AS revenue FROM orders GROUP BY {_clause}""",
    )
    def _(t, mode=_mode):
        aggs = [F.count("*").alias("n"), fx.money_sum("o_totalprice").alias("revenue")]
        return ag.subtotals(t.orders, ["o_orderstatus", "o_orderpriority"], aggs, mode)


@query(
    "d11_pivot",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
              count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def _(t):
    return ag.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query(
    "d12_unpivot",
    """SELECT l_orderkey, l_linenumber, metric, value FROM lineitem
       UNPIVOT (value FOR metric IN (l_discount, l_tax))""",
)
def _(t):
    return ag.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query(
    "d13_share_of_total",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY ALL)
       SELECT o_orderstatus, o_orderpriority, CAST(total AS DOUBLE) AS total,
              round(total::DOUBLE / (sum(total) OVER (PARTITION BY o_orderstatus))::DOUBLE, 8) AS share FROM g""",
)
def _(t):
    out = ag.share_of_total(
        t.orders, ["o_orderstatus", "o_orderpriority"], fx.money("o_totalprice"), ["o_orderstatus"]
    )
    return out.withColumns({"total": F.col("total").cast("double"), "share": F.round("share", 8)})


@query(
    "d14_aggregate_of_aggregate",
    """WITH d AS (SELECT c_mktsegment, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
                  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
       SELECT c_mktsegment, round(avg(v), 4) AS avg_value, max(v) AS max_value, min(v) AS min_value FROM d GROUP BY 1""",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = df.select("c_mktsegment", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    out = ag.agg_of_agg(df, ["c_mktsegment", "day"], ["c_mktsegment"], fx.money("o_totalprice"))
    return out.withColumn("avg_value", F.round("avg_value", 4))


@query(
    "d15_ratio_of_sums_vs_mean",
    """SELECT l_returnflag, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE, 6) AS of_sums,
              round(avg(l_extendedprice / l_quantity), 6) AS mean_of_ratios FROM lineitem GROUP BY 1""",
)
def _(t):
    a = ag.ratio(t.lineitem, fx.money("l_extendedprice"), fx.money("l_quantity"), ["l_returnflag"])
    b = ag.ratio(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"], "mean")
    a = a.select("l_returnflag", F.round("ratio", 6).alias("of_sums"))
    return a.join(b.select("l_returnflag", F.round("ratio", 6).alias("mean_of_ratios")), "l_returnflag")


@query(
    "d16_string_aggregation",
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS \"values\" FROM orders GROUP BY 1",
)
def _(t):
    return ag.concat_agg(t.orders, ["o_custkey"], "o_orderpriority")


@query(
    "d17_row_completeness",
    """SELECT o_orderkey, ((o_orderpriority <> '5-LOW')::INT + (o_orderstatus <> 'P')::INT + 1) / 3.0::DOUBLE AS completeness FROM orders""",
)
def _(t):
    df = t.orders.select(
        "o_orderkey",
        fx.nullify("o_orderpriority", ["5-LOW"]).alias("a"),
        fx.nullify("o_orderstatus", ["P"]).alias("b"),
        F.col("o_totalprice").alias("c"),
    )
    return ag.row_completeness(df, ["a", "b", "c"]).select("o_orderkey", "completeness")


@query(
    "d18_coarser_fact",
    f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_suppkey, {msum('l_extendedprice')} AS revenue, count(*) AS n_rows
        FROM lineitem GROUP BY ALL""",
)
def _(t):
    out = ag.build_aggregate(
        t.lineitem, [fx.period("l_shipdate", "month").alias("month"), "l_suppkey"], {"revenue": fx.money("l_extendedprice")}
    )
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query(
    "d19_daily_mart",
    f"""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS order_day, c_mktsegment AS segment, {msum('o_totalprice')} AS revenue, count(*) AS n_orders
                   FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 0 GROUP BY ALL)
        SELECT order_day, segment, revenue, n_orders, round(revenue / n_orders, 4) AS aov,
               round(revenue / CAST(sum(CAST(revenue AS DECIMAL(18,2))) OVER (PARTITION BY order_day) AS DOUBLE), 6) AS share FROM s""",
)
def _(t):
    return marts.daily_mart(t.orders, t.customer)
