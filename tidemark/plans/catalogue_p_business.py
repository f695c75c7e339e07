"""Business analyses."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import business as bz
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum, union

DEC = "DECIMAL(18,2)"


def r(*cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


@query(
    "p1_revenue_by_segment",
    f"""WITH g AS (SELECT c_mktsegment AS segment, {msum('o_totalprice')} AS revenue, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT segment, revenue, n_orders, round(revenue / n_orders, 6) AS aov, round(revenue / (SELECT {msum('o_totalprice')} FROM orders), 8) AS share FROM g""",
)
def _(t):
    out = bz.revenue_by_segment(t.orders, t.customer)
    return out.withColumns({"aov": F.round("aov", 6), "share": F.round("share", 8)})


@query(
    "p2_rfm",
    f"""WITH k AS (SELECT a.as_of, o_custkey, o_orderdate, o_totalprice FROM orders, (VALUES (DATE '1999-01-01'), (DATE '2000-01-01'), (DATE '2001-01-01')) a(as_of) WHERE o_orderdate < a.as_of),
             b AS (SELECT as_of, o_custkey, CAST(date_diff('day', max(o_orderdate), as_of) AS INTEGER) AS recency_days, count(*) AS frequency, {msum('o_totalprice')} AS monetary FROM k GROUP BY 1, 2),
             s AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY as_of ORDER BY -recency_days, o_custkey) AS INTEGER) AS r, CAST(ntile(5) OVER (PARTITION BY as_of ORDER BY frequency, o_custkey) AS INTEGER) AS f,
                          CAST(ntile(5) OVER (PARTITION BY as_of ORDER BY monetary, o_custkey) AS INTEGER) AS m FROM b)
        SELECT *, CASE WHEN r >= 4 AND (f + m) / 2.0 >= 4 THEN 'Champions' WHEN r >= 3 AND (f + m) / 2.0 >= 3 THEN 'Loyal' WHEN r <= 2 AND (f + m) / 2.0 >= 3 THEN 'At-Risk'
                  WHEN r <= 2 THEN 'Lost' WHEN r = 5 AND (f + m) / 2.0 < 3 THEN 'New' ELSE 'Regular' END AS segment FROM s""",
)
def _(t):
    return bz.rfm(t.orders, ["1999-01-01", "2000-01-01", "2001-01-01"], "o_custkey", "o_orderdate", "o_totalprice")


@query(
    "p3_clv",
    f"""WITH g AS (SELECT o_custkey, sum(CAST(o_totalprice AS {DEC})) AS v, min(o_orderdate) AS first, count(DISTINCT date_trunc('month', o_orderdate)) AS active FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1),
             l AS (SELECT *, greatest(1, 2001 * 12 + 1 - year(first) * 12 - month(first)) AS life FROM g),
             s AS (SELECT o_custkey, round(least(1.0, active::DOUBLE / life), 6)::DOUBLE AS purchase_probability, (v * 12 * least(active, life))::DOUBLE / (life * life)::DOUBLE AS clv FROM l)
        SELECT *, CAST(ntile(4) OVER (ORDER BY clv, o_custkey) AS INTEGER) AS tier FROM s""",
)
def _(t):
    return bz.clv(t.orders, "2001-01-01", "o_custkey", "o_orderdate", "o_totalprice")


@query(
    "p4_cohort_retention",
    f"""WITH a AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CAST(o_totalprice AS {DEC})) AS rev FROM orders GROUP BY 1, 2),
             s AS (SELECT o_custkey, min(month) AS cohort, arg_min(rev, month) AS rev0 FROM a GROUP BY 1), z AS (SELECT cohort, count(*) AS size, sum(rev0) AS base FROM s GROUP BY 1),
             g AS (SELECT cohort, CAST((year(month) - year(cohort)) * 12 + month(month) - month(cohort) AS INTEGER) AS month_offset, count(*) AS n_active, sum(rev) AS rev, sum(least(rev, rev0)) AS kept FROM a JOIN s USING (o_custkey) GROUP BY 1, 2)
        SELECT cohort, month_offset, n_active, round(n_active::DOUBLE / size, 8) AS retention, round(kept::DOUBLE / base::DOUBLE, 8) AS grr, round(rev::DOUBLE / base::DOUBLE, 8) AS nrr FROM g JOIN z USING (cohort)""",
)
def _(t):
    out = bz.cohort_retention(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    return out.select("cohort", "month_offset", "n_active", *r("retention", "grr", "nrr", n=8))


@query(
    "p5_market_basket",
    """WITH b AS (SELECT DISTINCT l_orderkey, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM b), f AS (SELECT i, count(*) AS c FROM b GROUP BY 1 HAVING count(*) >= 0.012 * (SELECT n FROM n)),
            p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n_baskets FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 0.012 * (SELECT n FROM n))
       SELECT item_a, item_b, n_baskets, round(n_baskets::DOUBLE / n, 8) AS support, round(n_baskets::DOUBLE / fa.c, 8) AS confidence_a_b, round(n_baskets::DOUBLE / fb.c, 8) AS confidence_b_a, round(n_baskets::DOUBLE * n / (fa.c * fb.c), 8) AS lift
       FROM p, n, f fa, f fb WHERE fa.i = item_a AND fb.i = item_b""",
)
def _(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    out = bz.market_basket(lines, "l_orderkey", "p_brand", 0.012)
    return out.select("item_a", "item_b", "n_baskets", *r("support", "confidence_a_b", "confidence_b_a", "lift", n=8))


@query(
    "p6_pareto",
    f"""WITH g AS (SELECT o_custkey, sum(CAST(o_totalprice AS {DEC})) AS total FROM orders GROUP BY 1), c AS (SELECT *, sum(total) OVER (ORDER BY total DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS cum, sum(total) OVER () AS al FROM g)
        SELECT o_custkey, total::DOUBLE AS total, round(cum::DOUBLE / al::DOUBLE, 8) AS cum_share, CASE WHEN (cum - total)::DOUBLE / al::DOUBLE < 0.8 THEN 'A' WHEN (cum - total)::DOUBLE / al::DOUBLE < 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM c""",
)
def _(t):
    out = bz.pareto(t.orders, "o_custkey", fx.money("o_totalprice"))
    return out.select("o_custkey", F.col("total").cast("double").alias("total"), F.round("cum_share", 8).alias("cum_share"), "abc_class")


AFTER = "l_shipdate >= TIMESTAMP '1999-01-01'"


def after(col="l_shipdate", day="1999-01-01"):
    return F.col(col) >= F.lit(day).cast("timestamp_ntz")


COMPS = ["l_quantity", "l_discount", "l_tax"]


@query(
    "p7_change_contribution",
    "WITH c AS (" + union(f"SELECT '{c}' AS component, avg({c}) FILTER (NOT ({AFTER})) AS b, avg({c}) FILTER ({AFTER}) AS a FROM lineitem" for c in COMPS)
    + ") SELECT component, round(b, 8) AS before, round(a, 8) AS after, round(a - b, 8) AS delta, round(100 * (a - b) / (SELECT sum(a - b) FROM c), 4) AS pct_of_change FROM c",
)
def _(t):
    out = bz.change_contribution(t.lineitem, after(), COMPS)
    return out.select("component", *r("before", "after", "delta", n=8), F.round("pct_of_change", 4).alias("pct_of_change"))


@query(
    "p8_driver_effects",
    f"""WITH g AS (SELECT l_returnflag, sum(CAST(l_extendedprice AS {DEC})) FILTER (NOT ({AFTER}))::DOUBLE AS n0, sum(l_quantity) FILTER (NOT ({AFTER})) AS d0, sum(CAST(l_extendedprice AS {DEC})) FILTER ({AFTER})::DOUBLE AS n1, sum(l_quantity) FILTER ({AFTER}) AS d1 FROM lineitem GROUP BY 1),
             w AS (SELECT *, d0 / sum(d0) OVER () AS w0, d1 / sum(d1) OVER () AS w1 FROM g)
        SELECT l_returnflag, round(n0 / d0, 6) AS rate_before, round(n1 / d1, 6) AS rate_after, round(w1 * (n1 / d1 - n0 / d0), 6) AS rate_effect, round((w1 - w0) * n0 / d0, 6) AS mix_effect FROM w""",
)
def _(t):
    out = bz.driver_effects(t.lineitem, "l_returnflag", after(), fx.money("l_extendedprice"), "l_quantity")
    return out.select("l_returnflag", *r("rate_before", "rate_after", "rate_effect", "mix_effect"))


@query(
    "p9_build_cycles",
    """WITH m AS (SELECT user_id, ts, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cycle_no FROM events WHERE event_type IN ('signup', 'purchase'))
       SELECT user_id, CAST(cycle_no AS BIGINT) AS cycle_no, min(ts) FILTER (event_type = 'signup') AS started_at, min(ts) FILTER (event_type = 'purchase') AS ended_at,
              round((epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'signup'))) / 3.6e9, 6) AS duration_hours FROM m WHERE cycle_no > 0 GROUP BY 1, 2""",
)
def _(t):
    out = bz.build_cycles(t.events, "user_id", "ts", "event_type", "signup", "purchase", ["event_id"])
    return out.withColumn("duration_hours", F.round("duration_hours", 6))


@query(
    "p10_fallback_source",
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS amount FROM orders),
            b AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1)
       SELECT o_orderkey, coalesce(a.amount, b.amount) AS amount, a.amount IS NULL AND b.amount IS NOT NULL AS has_fallback FROM a LEFT JOIN b USING (o_orderkey)""",
)
def _(t):
    a = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("amount"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(fx.money_sum("l_extendedprice").alias("amount"))
    return bz.with_fallback(a, b, ["o_orderkey"], ["amount"])


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def lines(t):
    return t.order_lines


@query(
    "p11_on_time_rate",
    f"""SELECT l_returnflag, round(100.0 * count(*) FILTER (abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) <= 43200 * 60000000::BIGINT) / count(*), 6)::DOUBLE AS on_time_pct FROM {LINES} GROUP BY 1""",
)
def _(t):
    out = bz.on_time_rate(lines(t), "o_orderdate", "l_shipdate", 43200, ["l_returnflag"])
    return out.withColumn("on_time_pct", F.round("on_time_pct", 6))


@query(
    "p12_otif",
    f"""SELECT o_orderpriority, round(100.0 * count(*) FILTER (l_shipdate <= o_orderdate + INTERVAL 365 DAY AND abs(l_quantity * (1 - l_tax) - l_quantity) / l_quantity <= 0.02) / count(*), 6)::DOUBLE AS otif_pct FROM {LINES} GROUP BY 1""",
)
def _(t):
    df = lines(t).withColumns({"due": F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), "received": F.col("l_quantity") * (1 - F.col("l_tax"))})
    out = bz.otif(df, "due", "l_shipdate", "l_quantity", "received", ["o_orderpriority"])
    return out.withColumn("otif_pct", F.round("otif_pct", 6))


@query(
    "p13_ratio_kpis",
    f"""SELECT l_linestatus, round(sum(CAST(l_extendedprice AS {DEC}))::DOUBLE / sum(l_quantity), 6) AS unit_revenue, round(100 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS returned_pct,
               round(100.0 * count(*) FILTER (l_tax > 0) / count(*), 6)::DOUBLE AS taxed_pct FROM lineitem GROUP BY 1""",
)
def _(t):
    q = F.col("l_quantity")
    kpis = {
        "unit_revenue": (fx.money("l_extendedprice"), q, 1.0),
        "returned_pct": (F.when(F.col("l_returnflag") == "R", q).otherwise(0.0), q, 100.0),
        "taxed_pct": ((F.col("l_tax") > 0).cast("int"), F.lit(1), 100.0),
    }
    return bz.kpi_table(t.lineitem, kpis, ["l_linestatus"]).select("l_linestatus", *r(*kpis))


@query(
    "p14_segment_compare",
    f"""WITH g AS (SELECT c_mktsegment, o_orderstatus, sum(CAST(o_totalprice AS {DEC})) FILTER (o_orderdate < TIMESTAMP '1998-01-01')::DOUBLE AS before, sum(CAST(o_totalprice AS {DEC})) FILTER (o_orderdate >= TIMESTAMP '1998-01-01')::DOUBLE AS after
                   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT *, round((after - before) / abs(before) * 100, 6) AS change_pct FROM g""",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = bz.segment_compare(df, ["c_mktsegment", "o_orderstatus"], after("o_orderdate", "1998-01-01"), fx.money("o_totalprice"))
    out = out.withColumns({"before": F.col("before").cast("double"), "after": F.col("after").cast("double")})
    return out.withColumn("change_pct", F.round("change_pct", 6))


@query(
    "p15_build_legs",
    """WITH n AS (SELECT user_id, event_type AS from_place, lead(event_type) OVER w AS to_place, ts AS left_at, lead(ts) OVER w AS arrived_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT *, round((epoch_us(arrived_at) - epoch_us(left_at)) / 3.6e9, 6) AS hours FROM n WHERE arrived_at IS NOT NULL""",
)
def _(t):
    return bz.build_legs(t.events, "user_id", "ts", "event_type", ["event_id"]).withColumn("hours", F.round("hours", 6))


@query(
    "p16_hourly_utilisation",
    """WITH a AS (SELECT ts AS s, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS e FROM events WHERE value > 0),
            h AS (SELECT s, e, unnest(generate_series(date_trunc('hour', s), date_trunc('hour', greatest(s, e - INTERVAL 1 MICROSECOND)), INTERVAL 1 HOUR)) AS hour FROM a)
       SELECT hour, round(sum(least(epoch_us(e), epoch_us(hour) + 3600000000) - greatest(epoch_us(s), epoch_us(hour)))::DOUBLE / 3.6e9, 8) AS busy_hours,
              round(sum(least(epoch_us(e), epoch_us(hour) + 3600000000) - greatest(epoch_us(s), epoch_us(hour)))::DOUBLE / 3.6e9 / 4, 8) AS utilisation FROM h GROUP BY 1""",
)
def _(t):
    span = F.round(F.col("value") * 60_000_000).cast("long")
    df = t.events.filter("value > 0").select("ts", F.timestamp_micros(fx.micros("ts") + span).cast("timestamp_ntz").alias("te"))
    return bz.hourly_utilisation(df, "ts", "te", 4).select("hour", *r("busy_hours", "utilisation", n=8))


@query(
    "p17_fixed_cohort",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS n_customers, {msum('o_totalprice')} AS revenue FROM orders
        WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995) GROUP BY 1""",
)
def _(t):
    kept = bz.fixed_cohort(t.orders, "o_custkey", F.year("o_orderdate") == 1995)
    return kept.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count_distinct(F.col("o_custkey")).alias("n_customers"), fx.money_sum("o_totalprice").alias("revenue")
    )
