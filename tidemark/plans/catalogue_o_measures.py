"""Measures and time intelligence."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import measures as ms
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum

DEC = "DECIMAL(18,2)"
DAILY = f"""s AS (SELECT c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS {DEC})) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
MONTHLY = f"""s AS (SELECT c_mktsegment AS seg, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CAST(o_totalprice AS {DEC})) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def facts(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("seg", F.col("c_mktsegment"))


def daily(t):
    return ms.daily_series(facts(t), ["seg"], "o_orderdate", "o_totalprice")


def monthly(t):
    return facts(t).groupBy("seg", fx.period("o_orderdate", "month").alias("month")).agg(
        F.sum(fx.money("o_totalprice")).alias("v"), F.count("*").alias("n")
    )


def model(t):
    dates = t.orders.select(F.col("o_orderdate").alias("d")).unionByName(t.lineitem.select(F.col("l_shipdate").alias("d")))
    dates = dates.distinct().select(F.col("d").alias("date"), F.year("d").alias("year"))
    geo = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    fact = t.order_lines
    return ms.Model(
        fact,
        {
            "customer": (geo.select("c_custkey", "c_mktsegment", "r_name"), {"buyer": "o_custkey"}, "c_custkey"),
            "part": (t.part, {"part": "l_partkey"}, "p_partkey"),
            "date": (dates, {"ordered": "o_orderdate", "shipped": "l_shipdate"}, "date"),
        },
        {
            "revenue": fx.money_sum("l_extendedprice"),
            "lines": F.count(F.lit(1)),
            "orders": F.count_distinct(F.col("l_orderkey")),
        },
    )


JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"


@query(
    "o1_evaluate_measures",
    f"""SELECT r_name, p_type, {msum('l_extendedprice')} AS revenue, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM {JOINED}
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""",
)
def _(t):
    return ms.evaluate(model(t), ["revenue", "lines", "orders"], ["r_name", "p_type"], {"c_mktsegment": ["BUILDING", "MACHINERY"]})


def _to_date_sql(start):
    return f"WITH {DAILY} SELECT seg, day, CAST(sum(v) OVER (PARTITION BY seg, {start} ORDER BY day) AS DOUBLE) AS total FROM s"


for _unit in ("month", "quarter", "year"):

    @query(f"o2_{_unit}_to_date", _to_date_sql(f"date_trunc('{_unit}', day)"))
    def _(t, unit=_unit):
        out = ms.to_date(daily(t), ["seg"], "day", "v", unit, out="total")
        return out.select("seg", "day", F.col("total").cast("double").alias("total"))


@query("o3_fiscal_year_to_date", _to_date_sql("date_trunc('year', day - INTERVAL 3 MONTH)"))
def _(t):
    out = ms.to_date(daily(t), ["seg"], "day", "v", "year", 4, "total")
    return out.select("seg", "day", F.col("total").cast("double").alias("total"))


def _prior_sql(src, date, step):
    return f"""WITH {src}, p AS (SELECT seg, CAST({date} + INTERVAL {step} AS DATE) AS d, arg_max(v, {date}) AS prior FROM s GROUP BY 1, 2)
        SELECT s.seg, {date}, v::DOUBLE AS v, prior::DOUBLE AS prior, round((v - prior)::DOUBLE / abs(prior)::DOUBLE * 100, 6) AS change_pct FROM s LEFT JOIN p ON p.seg = s.seg AND d = {date}"""


def _prior(df, date, unit):
    out = ms.vs_prior(df, ["seg"], date, "v", unit)
    return out.select("seg", date, F.col("v").cast("double").alias("v"), F.col("prior").cast("double").alias("prior"), F.round("change_pct", 6).alias("change_pct"))


@query("o4_vs_prior_year", _prior_sql(DAILY, "day", "12 MONTH"))
def _(t):
    return _prior(daily(t), "day", "year")


@query("o4_vs_prior_week", _prior_sql(DAILY, "day", "7 DAY"))
def _(t):
    return _prior(daily(t), "day", "week")


@query("o4_vs_prior_month", _prior_sql(MONTHLY, "month", "1 MONTH"))
def _(t):
    return _prior(monthly(t), "month", "month")


@query(
    "o5_trailing_12_months",
    f"WITH {MONTHLY} SELECT seg, month, CAST(sum(v) OVER (PARTITION BY seg ORDER BY year(month) * 12 + month(month) RANGE 11 PRECEDING) AS DOUBLE) AS t12 FROM s",
)
def _(t):
    out = ms.trailing(monthly(t), ["seg"], "month", "v", 12, "month")
    return out.select("seg", "month", F.col("trailing_12_month").cast("double").alias("t12"))


@query(
    "o5_trailing_30_days",
    f"WITH {DAILY} SELECT seg, day, CAST(sum(v) OVER (PARTITION BY seg ORDER BY date_diff('day', DATE '1970-01-01', day) RANGE 29 PRECEDING) AS DOUBLE) AS t30 FROM s",
)
def _(t):
    out = ms.trailing(daily(t), ["seg"], "day", "v", 30, "day")
    return out.select("seg", "day", F.col("trailing_30_day").cast("double").alias("t30"))


@query(
    "o6_prior_year_complete",
    f"""WITH {DAILY}, m AS (SELECT max(day) AS last FROM s),
        g AS (SELECT seg, sum(v) FILTER (day >= date_trunc('year', last) AND day <= last) AS current, sum(v) FILTER (day >= date_trunc('year', last - INTERVAL 1 YEAR) AND day <= last - INTERVAL 1 YEAR) AS prior FROM s, m GROUP BY 1)
        SELECT seg, current::DOUBLE AS current, prior::DOUBLE AS prior, round((current - prior)::DOUBLE / abs(prior)::DOUBLE * 100, 6) AS change_pct FROM g""",
)
def _(t):
    out = ms.vs_prior_complete(daily(t), ["seg"], "day", "v")
    return out.select("seg", F.col("current").cast("double").alias("current"), F.col("prior").cast("double").alias("prior"), F.round("change_pct", 6).alias("change_pct"))


@query(
    "o7_balances",
    f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'error' THEN -CAST(value AS {DEC}) ELSE CAST(value AS {DEC}) END) AS moved FROM events GROUP BY 1, 2),
            s AS (SELECT user_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), (SELECT CAST(max(day) AS TIMESTAMP) FROM d), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
            b AS (SELECT user_id, day, coalesce(moved, 0) AS moved, sum(coalesce(moved, 0)) OVER (PARTITION BY user_id ORDER BY day) AS bal FROM s LEFT JOIN d USING (user_id, day))
       SELECT user_id, CAST(date_trunc('week', day) AS DATE) AS period, arg_min(bal - moved, day)::DOUBLE AS opening, arg_max(bal, day)::DOUBLE AS closing, round(sum(bal)::DOUBLE / count(*), 4) AS average FROM b GROUP BY 1, 2""",
)
def _(t):
    v = F.when(F.col("event_type") == "error", -fx.money("value")).otherwise(fx.money("value"))
    out = ms.balances(t.events, "user_id", "ts", v, "week")
    return out.select("user_id", "period", F.col("opening").cast("double").alias("opening"), F.col("closing").cast("double").alias("closing"), F.round(F.col("average").cast("double"), 4).alias("average"))


def _variants(m):
    return f"""SELECT s.seg, s.month, '{m}' AS measure, x.variant, x.value FROM s LEFT JOIN s p ON p.seg = s.seg AND p.month + INTERVAL 1 YEAR = s.month,
      LATERAL (VALUES ('current', s.{m}::DOUBLE), ('ytd', s.{m}_ytd::DOUBLE), ('prior_year', p.{m}::DOUBLE), ('yoy_pct', round((s.{m} - p.{m})::DOUBLE / abs(p.{m})::DOUBLE * 100, 6))) x(variant, value)"""


@query(
    "o8_measure_variants",
    f"""WITH {MONTHLY.replace('s AS', 's0 AS')}, s AS (SELECT *, sum(v) OVER w AS v_ytd, sum(n) OVER w AS n_ytd FROM s0 WINDOW w AS (PARTITION BY seg, year(month) ORDER BY month))
        {_variants('v')} UNION ALL {_variants('n')}""",
)
def _(t):
    out = ms.calc_group(monthly(t), ["seg"], "month", ["v", "n"])
    return out.withColumn("value", F.when(F.col("variant") == "yoy_pct", F.round("value", 6)).otherwise(F.col("value")))


@query(
    "o9_percent_of",
    f"""WITH s AS (SELECT c_mktsegment AS seg, o_orderstatus, CAST(o_totalprice AS {DEC}) AS v, o_orderpriority = '1-URGENT' AS sel FROM orders JOIN customer ON o_custkey = c_custkey),
        g AS (SELECT seg, o_orderstatus, sum(v)::DOUBLE AS value FROM s WHERE sel GROUP BY 1, 2)
        SELECT seg, o_orderstatus, value, round(100 * value / (SELECT sum(v) FROM s)::DOUBLE, 6) AS pct_of_all, round(100 * value / (SELECT sum(v) FROM s WHERE sel)::DOUBLE, 6) AS pct_of_selected,
               round(100 * value / (SELECT sum(v) FROM s k WHERE k.seg = g.seg)::DOUBLE, 6) AS pct_of_kept FROM g""",
)
def _(t):
    out = ms.pct_of(facts(t), ["seg", "o_orderstatus"], fx.money("o_totalprice"), F.col("o_orderpriority") == "1-URGENT", keep=["seg"])
    cols = ["pct_of_all", "pct_of_selected", "pct_of_kept"]
    return out.select("seg", "o_orderstatus", F.col("value").cast("double").alias("value"), *[F.round(c, 6).alias(c) for c in cols])


@query(
    "o10_filter_modes",
    f"""SELECT 'overwrite' AS mode, {msum('l_extendedprice')} AS revenue FROM {JOINED} WHERE r_name IN ('ASIA', 'EUROPE') AND p_type = 'PROMO'
        UNION ALL SELECT 'intersect', {msum('l_extendedprice')} FROM {JOINED} WHERE r_name = 'ASIA' AND p_type = 'PROMO'""",
)
def _(t):
    base = {"r_name": ["ASIA", "AFRICA"], "p_type": ["PROMO"]}
    out = None
    for mode in ("overwrite", "intersect"):
        flt = ms.with_filters(base, {"r_name": ["ASIA", "EUROPE"]}, mode)
        one = ms.evaluate(model(t), ["revenue"], [], flt).select(F.lit(mode).alias("mode"), "revenue")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "o11_alternate_date_role",
    f"SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {msum('l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def _(t):
    return ms.evaluate(model(t), ["revenue"], ["year"], roles={"date": "shipped"})


@query(
    "o12_filter_by_values",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)",
)
def _(t):
    vip = t.customer.filter("c_acctbal > 9500").select("c_custkey")
    return ms.filter_by_values(t.orders, "o_custkey", vip).select("o_orderkey", "o_custkey")


@query(
    "o13_kpi_status",
    """WITH k AS (SELECT c_nationkey, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6)::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
       SELECT c_nationkey, value, round(100 * (33 - value) / 33, 6) AS shortfall_pct, CASE WHEN 100 * (33 - value) / 33 >= 10 THEN 'red' WHEN 100 * (33 - value) / 33 >= 5 THEN 'yellow' ELSE 'green' END AS status FROM k""",
)
def _(t):
    share = F.round(100.0 * F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count("*"), 6).alias("value")
    out = ms.kpi_status(facts(t).groupBy("c_nationkey").agg(share), ms.Kpi("finished_share", "%", 33.0), "value")
    return out.withColumn("shortfall_pct", F.round("shortfall_pct", 6))


@query(
    "o13_provisional_thresholds",
    f"""WITH {DAILY} SELECT round(quantile_cont(v::DOUBLE, 0.25), 6) AS p25, round(quantile_cont(v::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(v::DOUBLE, 0.75), 6) AS p75 FROM s""",
)
def _(t):
    out = ms.provisional_thresholds(daily(t).withColumn("v", F.col("v").cast("double")), "v")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "o14_kpi_strip",
    f"""WITH {MONTHLY}, w AS (SELECT * FROM s WHERE month <= DATE '2001-07-01' AND month > DATE '2000-06-01'),
        g AS (SELECT seg, list(v::DOUBLE ORDER BY month) AS s, string_agg(CAST(v AS VARCHAR), ',' ORDER BY month) AS series FROM w GROUP BY 1) SELECT seg, s[-1] AS value, round(s[-1] - s[-2], 2) AS delta, series FROM g""",
)
def _(t):
    df = monthly(t).withColumn("v", F.col("v").cast("double"))
    out = ms.kpi_strip(df, ["seg"], "month", "v", "2001-07-01", 13)
    series = F.array_join(F.transform("series", lambda x: x.cast("decimal(18,2)").cast("string")), ",")
    return out.withColumns({"delta": F.round("delta", 2), "series": series})


@query(
    "o15_vs_plan",
    f"""WITH {MONTHLY}, a AS (SELECT seg, CAST(year(month) AS INTEGER) AS year, sum(v) AS actual FROM s GROUP BY 1, 2), p AS (SELECT seg, year + 1 AS year, actual AS plan FROM a)
        SELECT seg, year, actual::DOUBLE AS actual, plan::DOUBLE AS plan, (coalesce(actual, 0) - coalesce(plan, 0))::DOUBLE AS variance,
               round((coalesce(actual, 0) - coalesce(plan, 0))::DOUBLE / abs(plan)::DOUBLE * 100, 6) AS variance_pct FROM a FULL JOIN p USING (seg, year)""",
)
def _(t):
    actual = monthly(t).withColumn("year", F.year("month"))
    plan = actual.withColumn("year", F.col("year") + 1)
    out = ms.vs_plan(actual, plan, ["seg", "year"], "v")
    out = out.withColumn("variance_pct", F.round("variance_pct", 6))
    return out.withColumns({c: F.col(c).cast("double") for c in ("actual", "plan", "variance")})


@query(
    "o16_ratio_change",
    """WITH g AS (SELECT l_returnflag, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, count(*) FILTER (l_discount > 0.05)::DOUBLE / count(*) AS ratio FROM lineitem GROUP BY 1, 2),
            p AS (SELECT *, lag(ratio) OVER (PARTITION BY l_returnflag ORDER BY period) AS prev FROM g)
       SELECT l_returnflag, period, round(ratio, 8) AS ratio, round(100 * (ratio - prev), 6) AS change_pp, round((ratio - prev) / abs(prev) * 100, 6) AS change_pct FROM p""",
)
def _(t):
    high = (F.col("l_discount") > 0.05).cast("long")
    out = ms.ratio_change(t.lineitem, ["l_returnflag"], high, F.lit(1), "l_shipdate", "quarter")
    return out.select("l_returnflag", "period", F.round("ratio", 8).alias("ratio"), F.round("change_pp", 6).alias("change_pp"), F.round("change_pct", 6).alias("change_pct"))


@query(
    "o17_seasonal_baseline",
    f"""WITH {MONTHLY} SELECT a.seg, a.month, a.v::DOUBLE AS v, round(avg(b.v::DOUBLE), 4) AS baseline, count(b.v) AS n_years, round((a.v::DOUBLE - avg(b.v::DOUBLE)) / avg(b.v::DOUBLE) * 100, 6) AS gap_pct
        FROM s a LEFT JOIN s b ON a.seg = b.seg AND a.month IN (b.month + INTERVAL 1 YEAR, b.month + INTERVAL 2 YEAR, b.month + INTERVAL 3 YEAR) GROUP BY a.seg, a.month, a.v""",
)
def _(t):
    out = ms.seasonal_baseline(monthly(t).drop("n").withColumn("v", F.col("v").cast("double")), ["seg"], "month", "v")
    return out.select("seg", "month", "v", F.round("baseline", 4).alias("baseline"), F.coalesce("n_years", F.lit(0)).alias("n_years"), F.round("gap_pct", 6).alias("gap_pct"))
