"""Drift and anomalies."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import drift as dr, robust
from tidemark.plans.registry import query
from tidemark.plans.sqltext import union

DEC = "DECIMAL(18,2)"
A, B = "l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1998-01-01'"
RAISED = "CASE WHEN l_quantity <= 5 THEN l_extendedprice + 5000 ELSE l_extendedprice END"
RENAMED = "CASE WHEN l_quantity <= 5 THEN 'R' ELSE l_returnflag END"


def pair(t):
    """Line prices before 1998 against later ones, of which small orders cost more and count as returned."""
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    later = t.lineitem.filter(F.col("l_shipdate") >= cut)
    return t.lineitem.filter(F.col("l_shipdate") < cut), later.withColumns({"l_extendedprice": F.expr(RAISED), "l_returnflag": F.expr(RENAMED)})


PAIR = f"a AS (SELECT l_extendedprice AS v, l_returnflag AS f FROM lineitem WHERE {A}), b AS (SELECT {RAISED} AS v, {RENAMED} AS f FROM lineitem WHERE {B})"


@query(
    "l1_psi",
    f"""WITH {PAIR}, c AS (SELECT """ + ", ".join(f"quantile_cont(v, {i / 10}) AS c{i}" for i in range(1, 10)) + """ FROM a),
        g AS (SELECT bin, count(*) FILTER (is_a)::DOUBLE / (SELECT count(*) FROM a) AS e, count(*) FILTER (NOT is_a)::DOUBLE / (SELECT count(*) FROM b) AS p
              FROM (SELECT is_a, """ + " + ".join(f"(v >= c{i})::INT" for i in range(1, 10)) + """ AS bin FROM (SELECT v, true AS is_a FROM a UNION ALL SELECT v, false FROM b), c) GROUP BY 1)
        SELECT round(sum((p - e) * ln(p / e)), 8) AS psi, count(*) AS n_bins, CASE WHEN sum((p - e) * ln(p / e)) < 0.1 THEN 'low' WHEN sum((p - e) * ln(p / e)) <= 0.25 THEN 'moderate' ELSE 'high' END AS band FROM g""",
)
def _(t):
    return dr.psi(*pair(t), "l_extendedprice").withColumn("psi", F.round("psi", 8))


@query(
    "l1_psi_strict",
    f"""WITH {PAIR}, c AS (SELECT """ + ", ".join(f"quantile_cont(v, {i / 10}) AS c{i}" for i in range(11)) + """ FROM a),
        g AS (SELECT bin, count(*) FILTER (is_a)::DOUBLE / (SELECT count(*) FROM a) AS e, count(*) FILTER (NOT is_a)::DOUBLE / (SELECT count(*) FROM b) AS p
              FROM (SELECT is_a, """ + " + ".join(f"(v >= c{i})::INT" for i in range(1, 10)) + """ AS bin FROM (SELECT v, true AS is_a FROM a UNION ALL SELECT v, false FROM b), c WHERE v BETWEEN c0 AND c10) GROUP BY 1)
        SELECT round(sum((p - e) * ln(p / e)), 8) AS psi, count(*) AS n_bins, CASE WHEN sum((p - e) * ln(p / e)) < 0.1 THEN 'low' WHEN sum((p - e) * ln(p / e)) <= 0.25 THEN 'moderate' ELSE 'high' END AS band FROM g""",
)
def _(t):
    return dr.psi(*pair(t), "l_extendedprice", strict_reference=True).withColumn("psi", F.round("psi", 8))


@query(
    "l2_psi_categorical",
    f"""WITH {PAIR}, g AS (SELECT f, count(*) FILTER (is_a)::DOUBLE / (SELECT count(*) FROM a) AS e, count(*) FILTER (NOT is_a)::DOUBLE / (SELECT count(*) FROM b) AS p
              FROM (SELECT f, true AS is_a FROM a UNION ALL SELECT f, false FROM b) GROUP BY 1)
        SELECT round(sum((p - e) * ln(p / e)), 10) AS psi, CASE WHEN sum((p - e) * ln(p / e)) < 0.1 THEN 'low' WHEN sum((p - e) * ln(p / e)) <= 0.25 THEN 'moderate' ELSE 'high' END AS band FROM g""",
)
def _(t):
    return dr.psi_cat(*pair(t), "l_returnflag").withColumn("psi", F.round("psi", 10))


ECDF = f"""{PAIR}, c AS (SELECT v, sum(x) AS na, sum(y) AS nb FROM (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY 1),
  e AS (SELECT v, (sum(na) OVER (ORDER BY v))::DOUBLE / (SELECT count(*) FROM a) AS fa, (sum(nb) OVER (ORDER BY v))::DOUBLE / (SELECT count(*) FROM b) AS fb, lead(v) OVER (ORDER BY v) AS nx FROM c)"""


@query("l3_ks_statistic", f"WITH {ECDF} SELECT round(max(abs(fa - fb)), 10) AS statistic, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b FROM e")
def _(t):
    return dr.ks2(*pair(t), "l_extendedprice").select(F.round("statistic", 10).alias("statistic"), "n_a", "n_b")


@query("l4_wasserstein", f"WITH {ECDF} SELECT round(sum(abs(fa - fb) * (nx - v)), 5) AS distance FROM e")
def _(t):
    return dr.wasserstein(*pair(t), "l_extendedprice").select(F.round("distance", 5).alias("distance"))


@query(
    "l5_chi2_goodness_of_fit",
    """WITH a AS (SELECT p_brand AS f FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'A'), b AS (SELECT p_brand AS f FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
            g AS (SELECT f, count(*) FILTER (is_a) AS e, count(*) FILTER (NOT is_a) AS o FROM (SELECT f, true AS is_a FROM a UNION ALL SELECT f, false FROM b) GROUP BY 1),
            x AS (SELECT e, o, e * (SELECT count(*) FROM b)::DOUBLE / (SELECT count(*) FROM a) AS ex FROM g)
       SELECT round(sum((o - ex) * (o - ex) / ex), 6) AS statistic, count(*) - 1 AS df, 0::BIGINT AS n_unseen, count(*) FILTER (ex < 5) AS n_low_expected FROM x WHERE e > 0""",
)
def _(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = dr.chi2_gof(df.filter("l_returnflag = 'A'"), df.filter("l_returnflag = 'R'"), "p_brand")
    return out.withColumn("statistic", F.round("statistic", 6))


def _desc(c, src="lineitem"):
    qs = ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))
    return f"""SELECT '{c}' AS "column", count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 5) AS std,
        round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 6) AS skewness, round(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3, 6) AS kurtosis, {qs} FROM {src}, (SELECT avg({c}) AS m FROM {src})"""


COLS = ["l_quantity", "l_extendedprice"]


def rounded(df):
    six = ("mean", "skewness", "kurtosis", "p5", "p25", "p50", "p75", "p95")
    return df.withColumns({c: F.round(c, 6) for c in six} | {"std": F.round("std", 5)})


@query("l6_descriptors", union(_desc(c) for c in COLS))
def _(t):
    return rounded(dr.descriptors(t.lineitem, COLS))


@query(
    "l6_category_descriptors",
    union(
        f"""SELECT '{c}' AS "column", count(*) AS n_distinct, round(-sum(s * ln(s)), 8) AS entropy, round(sum(s) FILTER (rk <= 10), 8) AS top_share
            FROM (SELECT {c}, count(*)::DOUBLE / sum(count(*)) OVER () AS s, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk FROM part GROUP BY {c})"""
        for c in ("p_brand", "p_type")
    ),
)
def _(t):
    out = dr.category_descriptors(t.part, ["p_brand", "p_type"])
    return out.withColumns({"entropy": F.round("entropy", 8), "top_share": F.round("top_share", 8)})


@query(
    "l7_band_check",
    union(
        f"""SELECT '{c}' AS "column", n.p50, round(n.m, 6) AS mean, b.q1 AS base_p25, b.q3 AS base_p75, round(b.m, 6) AS base_mean, n.p50 BETWEEN b.q1 AND b.q3 AS median_in_band, abs(n.m - b.m) <= 0.05 * abs(b.m) AS mean_within_5pct
            FROM (SELECT round(quantile_cont({c}, 0.5), 6) AS p50, avg({c}) AS m FROM (SELECT * REPLACE ({RAISED} AS l_extendedprice) FROM lineitem) WHERE {B}) n, (SELECT round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3, avg({c}) AS m FROM lineitem WHERE {A}) b"""
        for c in COLS
    ),
)
def _(t):
    a, b = pair(t)
    out = dr.band_check(dr.descriptors(b, COLS), dr.descriptors(a, COLS))
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "mean", "base_p25", "base_p75", "base_mean")})


DAILY = f"s AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS {DEC})) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"
DN = "date_diff('day', DATE '1970-01-01', day)"


def daily(t):
    return t.events.groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n"), fx.money_sum("value").alias("v")
    )


@query(
    "l8_seasonal_naive",
    f"WITH {DAILY} SELECT a.k, a.day, a.v, b.v AS forecast, round(a.v - b.v, 2) AS residual FROM s a LEFT JOIN s b ON a.k = b.k AND b.day + 7 = a.day",
)
def _(t):
    out = dr.seasonal_naive(daily(t), ["k"], "day", "v", 7)
    return out.select("k", "day", "v", "forecast", F.round("residual", 2).alias("residual"))


@query(
    "l9_sigma_anomalies",
    f"""WITH {DAILY}, w AS (SELECT k, day, v, avg(v) OVER x AS centre, stddev_samp(v) OVER x AS spread FROM s WINDOW x AS (PARTITION BY k ORDER BY {DN} RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING))
        SELECT k, day, v, round(centre, 6) AS centre, round(spread, 6) AS spread, coalesce(abs(v - centre) > 2 * spread, false) AS is_anomaly FROM w""",
)
def _(t):
    out = dr.anomalies(daily(t), ["k"], "day", "v", "sigma", 14, 2)
    return out.select("k", "day", "v", F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"), "is_anomaly")


@query(
    "l9_mad_anomalies",
    f"""WITH {DAILY}, m AS (SELECT k, median(v) AS c FROM s GROUP BY 1), d AS (SELECT k, day, v, c, abs(v - c) AS dev FROM s JOIN m USING (k)), x AS (SELECT k, median(dev) AS mad FROM d GROUP BY 1)
        SELECT k, day, v, round(c, 6) AS centre, round(1.4826 * mad, 6) AS spread, abs(v - c) > 2 * 1.4826 * mad AS is_anomaly FROM d JOIN x USING (k)""",
)
def _(t):
    out = dr.anomalies(daily(t), ["k"], "day", "v", "mad", k=2)
    return out.select("k", "day", "v", F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"), "is_anomaly")


@query(
    "l10_decomposition",
    f"""WITH {DAILY}, t AS (SELECT k, day, v, CASE WHEN count(v) OVER w >= 7 THEN avg(v) OVER w END AS trend, {DN} % 7 AS ph FROM s WINDOW w AS (PARTITION BY k ORDER BY {DN} RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
             z AS (SELECT k, ph, avg(v - trend) AS seasonal FROM t GROUP BY 1, 2)
        SELECT k, day, v, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(v - trend - seasonal, 4) AS residual FROM t LEFT JOIN z USING (k, ph)""",
)
def _(t):
    out = dr.decompose(daily(t), ["k"], "day", "v", 7)
    return out.select("k", "day", "v", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "residual")])


def _robust(rounds=4, period=7, half=7):
    """The rounds of weighted lines, phase means and bisquare weights, one CTE after another."""
    parts = [f"r0 AS (SELECT k, day, v::DOUBLE AS y, {DN} AS d, {DN} % {period} AS ph, ({DN} - min({DN}) OVER (PARTITION BY k))::DOUBLE AS t, 1.0::DOUBLE AS w, 0.0::DOUBLE AS s FROM s)"]
    for i in range(rounds):
        parts += [
            f"""a{i} AS (SELECT *, sum(w) OVER x AS a0, sum(w * t) OVER x AS a1, sum(w * t * t) OVER x AS a2, sum(w * (y - s)) OVER x AS b0, sum(w * t * (y - s)) OVER x AS b1
                FROM r{i} WINDOW x AS (PARTITION BY k ORDER BY d RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING))""",
            f"""b{i} AS (SELECT *, CASE WHEN a0 * a2 - a1 * a1 > 1e-6 THEN (a2 * b0 - a1 * b1 + t * (a0 * b1 - a1 * b0)) / (a0 * a2 - a1 * a1) ELSE b0 / a0 END AS trend FROM a{i})""",
            f"c{i} AS (SELECT *, sum(w * (y - trend)) OVER (PARTITION BY k, ph) / sum(w) OVER (PARTITION BY k, ph) AS raw FROM b{i})",
            f"d{i} AS (SELECT *, raw - sum(w * raw) OVER (PARTITION BY k) / sum(w) OVER (PARTITION BY k) AS seasonal FROM c{i})",
            f"m{i} AS (SELECT k, median(abs(y - trend - seasonal)) AS m FROM d{i} GROUP BY 1)",
            f"""r{i + 1} AS (SELECT k, day, y, d, ph, t, seasonal AS s, {"trend, y - trend - seasonal AS residual, " if i == rounds - 1 else ""}
                CASE WHEN abs(y - trend - seasonal) < 6 * m THEN pow(1 - pow(abs(y - trend - seasonal) / (6 * m), 2), 2) ELSE 0.0 END AS w FROM d{i} JOIN m{i} USING (k))""",
        ]
    return ", ".join(parts) + f" SELECT k, day, y AS v, round(trend, 4) AS trend, round(s, 4) AS seasonal, round(residual, 4) AS residual, round(w, 4) AS weight FROM r{rounds}"


@query("l10_robust_decomposition", f"WITH {DAILY}, {_robust()}")
def _(t):
    out = robust.robust_decompose(daily(t).withColumn("v", F.col("v").cast("double")), ["k"], "day", "v", 7)
    return out.select("k", "day", "v", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "residual", "weight")])


@query(
    "l11_volume_anomaly",
    f"""WITH c AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(day)::TIMESTAMP FROM c), (SELECT max(day)::TIMESTAMP FROM c), INTERVAL 1 DAY)) AS DATE) AS day),
             f AS (SELECT day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)), w AS (SELECT day, n, avg(n) OVER x AS mean, stddev_samp(n) OVER x AS sd FROM f WINDOW x AS (ORDER BY {DN} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
        SELECT day, n, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN n = 0 THEN 'empty' WHEN n >= 10 * mean THEN 'tenfold' WHEN abs(n - mean) > 3 * sd THEN 'outside_band' ELSE 'ok' END AS flag FROM w""",
)
def _(t):
    counts = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    out = dr.volume_anomaly(counts, "day", "n")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(
    "l12_column_drift",
    "WITH r AS (" + union(f"""SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, '{c}' AS "column", avg({c}) AS mean, count(DISTINCT {c})::DOUBLE AS cardinality FROM lineitem GROUP BY 1""" for c in COLS)
    + """), l AS (SELECT max(q) AS m FROM r),
      g AS (SELECT "column", max(mean) FILTER (q = m) AS mean, avg(mean) FILTER (q <> m) AS mean_avg, stddev_samp(mean) FILTER (q <> m) AS mean_sd, max(cardinality) FILTER (q = m) AS cardinality, avg(cardinality) FILTER (q <> m) AS cardinality_avg, stddev_samp(cardinality) FILTER (q <> m) AS cardinality_sd FROM r, l GROUP BY 1)
      SELECT "column", round(mean, 5) AS mean, round(mean_avg, 5) AS mean_avg, round(cardinality_sd, 5) AS cardinality_sd, abs(mean - mean_avg) > 3 * mean_sd AS mean_drift, abs(cardinality - cardinality_avg) > 3 * cardinality_sd AS cardinality_drift FROM g""",
)
def _(t):
    out = dr.column_drift(t.lineitem.withColumn("q", fx.period("l_shipdate", "quarter")), "q", COLS)
    return out.select("column", *[F.round(c, 5).alias(c) for c in ("mean", "mean_avg", "cardinality_sd")], "mean_drift", "cardinality_drift")


@query(
    "l13_modified_z",
    """WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT event_id, value, m, abs(value - m) AS dev FROM events, m), x AS (SELECT median(dev) AS mad FROM d)
       SELECT event_id, round(0.6745 * (value - m) / mad, 6) AS modified_z FROM d, x WHERE abs(0.6745 * (value - m) / mad) > 3.5""",
)
def _(t):
    return dr.modified_z(t.events, "value").select("event_id", F.round("modified_z", 6).alias("modified_z"))


@query("l13_robust_distances", "SELECT count(*) AS n, count(*) AS n_scored, count(*) AS n_outliers FROM customer WHERE c_custkey % 8 = 0")
def _(t):
    """A cluster of an eighth of all customers is moved off the line that the others lie on; all of it is found."""
    noise = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("double") / 16777.216
    planted = F.col("c_custkey") % 8 == 0
    df = t.customer.withColumn("y", 2 * F.col("c_acctbal") + noise + F.when(planted, 9000).otherwise(0))
    out = robust.robust_distances(df, ["c_acctbal", "y"]).filter(planted)
    return out.agg(F.count("*").alias("n"), F.count("distance").alias("n_scored"), F.count(F.when(F.col("is_outlier"), 1)).alias("n_outliers"))


INTERVAL = f"""{DAILY}, r AS (SELECT a.k, a.day, a.v, b.v AS forecast, a.v - b.v AS residual FROM s a LEFT JOIN s b ON a.k = b.k AND b.day + 7 = a.day),
  i AS (SELECT a.k, a.day, any_value(a.v) AS v, any_value(a.forecast) AS forecast, any_value(a.forecast) + quantile_cont(p.residual, 0.1) AS lower, any_value(a.forecast) + quantile_cont(p.residual, 0.9) AS upper FROM r a LEFT JOIN r p ON p.k = a.k AND p.day < a.day GROUP BY 1, 2)"""


@query(
    "l14_naive_interval",
    f"WITH {INTERVAL} SELECT k, day, v, round(lower, 4) AS lower, round(upper, 4) AS upper, v BETWEEN lower AND upper AS inside FROM i",
)
def _(t):
    out = dr.naive_interval(daily(t), ["k"], "day", "v", 7)
    return out.select("k", "day", "v", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "inside")


@query(
    "l14_interval_coverage",
    f"WITH {INTERVAL} SELECT k, count(*) AS n, round(count(*) FILTER (v BETWEEN lower AND upper)::DOUBLE / count(*), 8) AS coverage FROM i WHERE (v BETWEEN lower AND upper) IS NOT NULL GROUP BY 1",
)
def _(t):
    out = dr.interval_coverage(dr.naive_interval(daily(t), ["k"], "day", "v", 7), ["k"])
    return out.withColumn("coverage", F.round("coverage", 8))
