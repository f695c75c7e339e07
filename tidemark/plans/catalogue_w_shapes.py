"""Chart-ready shapes."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.functions import distributions as ds
from tidemark.operators import shapes as sh
from tidemark.plans.registry import query

DEC = "DECIMAL(18,2)"


@query(
    "w1_boxplot",
    """WITH v AS (SELECT o_orderstatus, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderstatus),
            q AS (SELECT o_orderstatus, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
       SELECT o_orderstatus, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
              max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi, count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
       FROM v JOIN q USING (o_orderstatus) GROUP BY o_orderstatus, q1, median, q3""",
)
def _(t):
    df = t.order_lines
    df = df.groupBy("l_orderkey", "o_orderstatus").agg(fx.money_sum("l_extendedprice").alias("v"))
    out = sh.boxplot_stats(df, ["o_orderstatus"], "v")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    "w2_ecdf",
    """WITH c AS (SELECT o_totalprice AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, round(sum(n) OVER (ORDER BY value)::DOUBLE / sum(n) OVER ()::DOUBLE, 8) AS share FROM c""",
)
def _(t):
    return sh.ecdf(t.orders, "o_totalprice").withColumn("share", F.round("share", 8))


@query(
    "w2_ecdf_binned",
    """WITH c AS (SELECT CAST(greatest(0, ceil((l_quantity - 1) / (49 / 7.0) - 1e-12)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT bin, 1 + bin * 7.0::DOUBLE AS value, round(sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER ()::DOUBLE, 8) AS share FROM c""",
)
def _(t):
    return sh.ecdf(t.lineitem, "l_quantity", 7).withColumn("share", F.round("share", 8))


@query(
    "w3_bins_2d",
    """WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
       SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19) AS INTEGER) AS bx, CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19) AS INTEGER) AS by, count(*) AS n FROM lineitem, e GROUP BY 1, 2""",
)
def _(t):
    return sh.bins2d(t.lineitem, "l_quantity", "l_extendedprice", 20)


def _ratio(top, bottom, x):
    """A ratio of two polynomials as SQL text."""
    def poly(coefficients):
        out = "0.0::DOUBLE"
        for c in coefficients:
            out = f"({out} * {x} + ({c!r})::DOUBLE)"
        return out

    return f"{poly(top)} / {poly(bottom)}"


# the published rational approximation of the normal quantile, in SQL
MIDDLE = f"{_ratio(ds.QUANTILE_A, (*ds.QUANTILE_B, 1.0), '((p - 0.5) * (p - 0.5))')} * (p - 0.5)"
LOW, HIGH = (_ratio(ds.QUANTILE_C, (*ds.QUANTILE_D, 1.0), f"sqrt(-2 * ln({q}))") for q in ("p", "1 - p"))


@query(
    "w4_qq_points",
    f"""WITH q AS (SELECT i / 20.0::DOUBLE AS p FROM range(1, 20) AS r(i)), m AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders),
             s AS (SELECT unnest(range(1, 20)) AS i, unnest((SELECT quantile_cont(o_totalprice, [{", ".join(str(i / 20) for i in range(1, 20))}]) FROM orders)) AS sample)
        SELECT round(p, 6) AS p, round(sample, 6) AS sample, round(mu + sd * CASE WHEN p < 0.02425 THEN {LOW} WHEN p > 1 - 0.02425 THEN -({HIGH}) ELSE {MIDDLE} END, 4) AS theoretical
        FROM q JOIN s ON s.i = round(q.p * 20), m""",
)
def _(t):
    out = sh.qq_points(t.orders, "o_totalprice", 19)
    return out.select(F.round("p", 6).alias("p"), F.round("sample", 6).alias("sample"), F.round("theoretical", 4).alias("theoretical"))


@query(
    "w5_downsample",
    """WITH e AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
       SELECT CAST(least(floor(((epoch_us(ts) - lo) * 200)::DOUBLE / (hi - lo)::DOUBLE), 199) AS INTEGER) AS bucket, min(ts) AS t0, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(*) AS n FROM events, e GROUP BY 1""",
)
def _(t):
    return sh.downsample(t.events, "ts", "value", 200).withColumn("mean", F.round("mean", 6))


MONTHLY = f"s AS (SELECT c_mktsegment AS seg, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CAST(o_totalprice AS {DEC})) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(
    "w6_indexed_series",
    f"WITH {MONTHLY} SELECT s.seg, s.month, round(100 * s.v::DOUBLE / b.v::DOUBLE, 6) AS indexed FROM s LEFT JOIN s b ON b.seg = s.seg AND b.month = DATE '1996-01-01'",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = df.groupBy(F.col("c_mktsegment").alias("seg"), fx.period("o_orderdate", "month").alias("month")).agg(F.sum(fx.money("o_totalprice")).alias("v"))
    return sh.index_to(s, ["seg"], "month", "v", "1996-01-01").select("seg", "month", F.round("indexed", 6).alias("indexed"))


@query(
    "w7_rank_change",
    f"""WITH a AS (SELECT o_custkey, rank() OVER (ORDER BY sum(CAST(o_totalprice AS {DEC})) DESC) AS rank_1 FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
             b AS (SELECT o_custkey, rank() OVER (ORDER BY sum(CAST(o_totalprice AS {DEC})) DESC) AS rank_2 FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)
        SELECT o_custkey, rank_1, rank_2, rank_1 - rank_2 AS move FROM a FULL JOIN b USING (o_custkey)""",
)
def _(t):
    y = F.year("o_orderdate")
    return sh.rank_change(t.orders.filter(y == 1997), t.orders.filter(y == 1998), "o_custkey", fx.money("o_totalprice"))


@query(
    "w8_flow_links",
    """WITH n AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) SELECT source, target, count(*) AS n FROM n WHERE target IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return sh.flow_links(t.events, "user_id", "ts", "event_type", ["event_id"])
