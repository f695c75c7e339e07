"""Window functions over raw rows and daily series."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import windows as wn
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum

DAILY = f"""daily AS (SELECT c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS day, {msum('o_totalprice')} AS v, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def daily(t):
    """Daily revenue per segment: the series the window operators run on."""
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return df.groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderdate").cast("date").alias("day")).agg(
        fx.money_sum("o_totalprice").alias("v"), F.count("*").alias("n")
    )


@query(
    "e1_dedup_latest",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t):
    df = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return wn.dedup_latest(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(
    "e2_ranks",
    """SELECT c_custkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter
       FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000))""",
)
def _(t):
    df = t.customer.withColumn("k", F.floor(F.col("c_acctbal") / 1000))
    out = wn.rank_by(df, ["c_nationkey"], ["k"], ["rank", "dense_rank"])
    out = wn.rank_by(out, ["c_nationkey"], ["c_acctbal", "c_custkey"], ["ntile"], 4)
    return out.select(
        "c_custkey",
        F.col("rank").cast("long").alias("rank"),
        F.col("dense_rank").cast("long").alias("dense_rank"),
        F.col("ntile").cast("long").alias("quarter"),
    )


@query(
    "e3_running_total",
    f"""WITH {DAILY} SELECT seg, day, CAST(sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY seg ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
        FROM daily""",
)
def _(t):
    out = wn.running(daily(t), ["seg"], ["day"], fx.money("v"), "running")
    return out.select("seg", "day", F.col("running").cast("double").alias("running"))


@query(
    "e4_moving_average",
    f"""WITH {DAILY} SELECT seg, day, round(avg(v) OVER (PARTITION BY seg ORDER BY day ROWS 6 PRECEDING), 4) AS ma7 FROM daily""",
)
def _(t):
    return wn.moving_avg(daily(t), ["seg"], ["day"], "v", 7, "ma7").select("seg", "day", F.round("ma7", 4).alias("ma7"))


@query(
    "e5_moving_days",
    f"""WITH {DAILY} SELECT seg, day, CAST(sum(n) OVER (w RANGE 6 PRECEDING) AS BIGINT) AS sum_7d, CAST(sum(n) OVER (w RANGE 29 PRECEDING) AS BIGINT) AS sum_30d,
              CAST(sum(n) OVER (w RANGE 89 PRECEDING) AS BIGINT) AS sum_90d
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', day) AS dn FROM daily) WINDOW w AS (PARTITION BY seg ORDER BY dn)""",
)
def _(t):
    return wn.moving_days(daily(t), ["seg"], "day", "n", [7, 30, 90]).select("seg", "day", "sum_7d", "sum_30d", "sum_90d")


@query(
    "e6_deltas",
    f"""WITH {DAILY} SELECT seg, day, round(v - lag(v) OVER w, 2) AS delta_prev, round(lead(v) OVER w - v, 2) AS delta_next
        FROM daily WINDOW w AS (PARTITION BY seg ORDER BY day)""",
)
def _(t):
    out = wn.delta(daily(t), ["seg"], ["day"], "v")
    return out.select("seg", "day", F.round("delta_prev", 2).alias("delta_prev"), F.round("delta_next", 2).alias("delta_next"))


@query(
    "e7_year_over_year",
    f"""WITH {DAILY}, p AS (SELECT seg, CAST(day + INTERVAL 12 MONTH AS DATE) AS d, arg_max(v, day) AS prior_year FROM daily GROUP BY 1, 2)
        SELECT daily.seg, day, v, prior_year, round((v - prior_year) / abs(prior_year) * 100, 6) AS yoy_pct
        FROM daily LEFT JOIN p ON p.seg = daily.seg AND p.d = day""",
)
def _(t):
    out = wn.yoy(daily(t), ["seg"], "day", "v")
    return out.select("seg", "day", "v", "prior_year", F.round("yoy_pct", 6).alias("yoy_pct"))


@query(
    "e8_known_values",
    f"""WITH {DAILY}, s AS (SELECT seg, day, CASE WHEN n >= 2 THEN v END AS v2 FROM daily)
        SELECT seg, day, first_value(v2 IGNORE NULLS) OVER w AS first_known, last_value(v2 IGNORE NULLS) OVER w AS last_known
        FROM s WINDOW w AS (PARTITION BY seg ORDER BY day ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    df = daily(t).withColumn("v2", F.when(F.col("n") >= 2, F.col("v")))
    return wn.snapshot_value(df, ["seg"], ["day"], "v2").select("seg", "day", "first_known", "last_known")


@query(
    "e9_group_transform",
    """SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_partkey) AS part_qty FROM lineitem""",
)
def _(t):
    out = wn.group_transform(t.lineitem, ["l_partkey"], "l_quantity", "sum", "part_qty")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "part_qty")


@query(
    "e10_rolling_ratio",
    f"""WITH d AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, count(*) FILTER (l_discount > 0.05) AS num, count(*) AS den FROM lineitem GROUP BY ALL)
        SELECT flag, day, round(CAST(sum(num) OVER w AS DOUBLE) / nullif(sum(den) OVER w, 0), 8) AS r28
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', day) AS dn FROM d) WINDOW w AS (PARTITION BY flag ORDER BY dn RANGE 27 PRECEDING)""",
)
def _(t):
    d = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("day")).agg(
        F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("num"), F.count("*").alias("den")
    )
    out = wn.rolling_ratio(d, ["flag"], "day", "num", "den", 28, "r28")
    return out.select("flag", "day", F.round("r28", 8).alias("r28"))


@query(
    "e11_rows_vs_range",
    f"""WITH m AS (SELECT seg, CAST(date_trunc('month', day) AS DATE) AS month, n FROM ({"WITH " + DAILY} SELECT * FROM daily)),
             d AS (SELECT seg, month, n, count(*) AS c FROM m GROUP BY ALL)
        SELECT seg, month, n, CAST(sum(c) OVER (PARTITION BY seg ORDER BY month, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS by_rows,
               CAST(sum(c) OVER (PARTITION BY seg ORDER BY month RANGE UNBOUNDED PRECEDING) AS BIGINT) AS by_range FROM d""",
)
def _(t):
    from pyspark.sql import Window as W

    d = daily(t).groupBy("seg", fx.period("day", "month").alias("month"), "n").agg(F.count("*").alias("c"))
    rows = W.partitionBy("seg").orderBy("month", "n").rowsBetween(W.unboundedPreceding, 0)
    peers = W.partitionBy("seg").orderBy("month").rangeBetween(W.unboundedPreceding, 0)
    return d.select("seg", "month", "n", F.sum("c").over(rows).alias("by_rows"), F.sum("c").over(peers).alias("by_range"))


@query(
    "e12_sequence_gaps",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, expected_seq FROM
       (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS expected_seq FROM lineitem)
       WHERE l_linenumber <> expected_seq""",
)
def _(t):
    out = wn.sequence_gaps(
        t.lineitem.withColumn("seq", F.col("l_linenumber").cast("long")), ["l_orderkey"], "seq",
        ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"],
    )
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "expected_seq")


@query(
    "e13_top_n_per_group",
    """SELECT c_mktsegment, c_custkey, c_acctbal FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3""",
)
def _(t):
    df = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    return wn.top_n_per_group(df, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
