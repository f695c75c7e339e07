"""Features, splits and model evaluation."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import drift as dr
from tidemark.operators import features as ft
from tidemark.plans.registry import query
from tidemark.plans.sqltext import union
from tidemark.session import settle

DEC = "DECIMAL(18,2)"
DATES = ["2024-01-08", "2024-01-15", "2024-01-22"]
DATES_SQL = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in DATES) + ") a(as_of)"


def rnd(*cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


@query(
    "r1_temporal_split",
    """SELECT split, count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM (SELECT o_orderdate, CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'train' WHEN o_orderdate < DATE '2000-07-01' THEN 'val' ELSE 'test' END AS split FROM orders) GROUP BY 1""",
)
def _(t):
    out = ft.split_temporal(t.orders, "o_orderdate", "1999-01-01", "2000-07-01")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


@query(
    "r2_walk_forward_folds",
    "WITH d AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders), c AS (SELECT "
    + ", ".join(f"ceil(quantile_cont(d, {i}.0 / 5)) AS c{i}" for i in range(1, 5)) + " FROM d), f AS ("
    + union(f"SELECT {i} AS fold, c{i} AS a, {f'c{i + 1}' if i < 4 else '2147483647'} AS b FROM c" for i in range(1, 5))
    + """), r AS (SELECT fold, CASE WHEN d < a - 7 THEN 'train' WHEN d >= a AND d < b THEN 'test' END AS role FROM d, f)
      SELECT fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return ft.time_folds(t.orders, "o_orderdate", 4, 7).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(
    "r3_user_features",
    f"""SELECT user_id, as_of, count(*) AS events_window, count(*) FILTER (CAST(ts AS DATE) >= as_of - 30) AS events_30d, CAST(date_diff('day', max(CAST(ts AS DATE)), as_of) AS INTEGER) AS days_since_last,
              CAST(sum(CAST(value AS {DEC})) AS DOUBLE) AS spend_window, count(*) FILTER (event_type = 'error') AS tickets FROM events, {DATES_SQL} WHERE CAST(ts AS DATE) >= as_of - 180 AND CAST(ts AS DATE) <= as_of - 1 GROUP BY 1, 2""",
)
def _(t):
    return ft.user_features(t.events, DATES, "user_id", "ts", "event_type", "value", "error")


@query(
    "r4_churn_labels",
    f"""WITH k AS (SELECT user_id, as_of, count(*) FILTER (CAST(ts AS DATE) < as_of) AS b, count(*) FILTER (CAST(ts AS DATE) >= as_of + 3 AND CAST(ts AS DATE) < as_of + 5) AS l FROM events, {DATES_SQL} GROUP BY 1, 2)
        SELECT user_id, as_of, (l = 0)::INT AS churn FROM k WHERE b > 0""",
)
def _(t):
    return ft.churn_labels(t.events, DATES, "user_id", "ts", 3, 5)


@query(
    "r5_leakage_audit",
    """SELECT 'l_shipdate' AS feature, count(*) FILTER (l_shipdate >= o_orderdate) AS n_leaks, CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS worst_days, count(*) FILTER (l_shipdate >= o_orderdate) = 0 AS is_clean FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    df = t.order_lines
    return ft.leakage_audit(df, "o_orderdate", ["l_shipdate"])


HOLE = "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END"


@query(
    "r6_median_impute",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce({HOLE}, (SELECT quantile_cont({HOLE}, 0.5) FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')) AS q, ({HOLE} IS NULL)::INT AS q_missing FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""",
)
def _(t):
    df = t.lineitem.withColumn("q", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    out = ft.impute(df.filter(F.col("l_shipdate") < cut), df.filter(F.col("l_shipdate") >= cut), ["q"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "q", "q_missing")


@query(
    "r7_encode",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_type <> 'PROMO' AND p_brand <> 'Brand#7' GROUP BY 1), e AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code, n::DOUBLE / sum(n) OVER () AS freq FROM c)
       SELECT p_partkey, CAST(coalesce(code, -1) AS BIGINT) AS p_brand_code, round(coalesce(freq, 0), 8) AS p_brand_freq FROM part LEFT JOIN e USING (p_brand) WHERE p_type = 'PROMO'""",
)
def _(t):
    train = t.part.filter("p_type <> 'PROMO' AND p_brand <> 'Brand#7'")
    out = ft.encode(train, t.part.filter("p_type = 'PROMO'"), ["p_brand"])
    return out.select("p_partkey", F.col("p_brand_code").cast("long").alias("p_brand_code"), F.round("p_brand_freq", 8).alias("p_brand_freq"))


DAILY = "s AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"
BASE = f"""{DAILY}, b AS (SELECT s.k, s.day, s.n, p.n AS seasonal_naive, lag(s.n) OVER w AS last_value, avg(s.n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS moving_average FROM s LEFT JOIN s p ON p.k = s.k AND p.day + 7 = s.day WINDOW w AS (PARTITION BY s.k ORDER BY s.day))"""


def series(t):
    return t.events.groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("r8_forecast_baselines", f"WITH {BASE} SELECT k, day, n, seasonal_naive, last_value, round(moving_average, 6) AS moving_average FROM b")
def _(t):
    out = ft.baselines(series(t), ["k"], "day", "n")
    return out.select("k", "day", "n", "seasonal_naive", "last_value", F.round("moving_average", 6).alias("moving_average"))


SCORED = """x AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, (o_orderstatus = 'F')::INT AS y, round(0.75 * (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6))::BIGINT / 16777216.0::DOUBLE) + 0.25 * (o_orderstatus = 'F')::INT, 3)::DOUBLE AS p FROM orders)"""


def scored(t):
    """Orders with a label (finished) and a noisy score derived from a hash of the key."""
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    y = (F.col("o_orderstatus") == "F").cast("int")
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", y.alias("y"), F.round(0.75 * h + 0.25 * y, 3).alias("p"))


@query(
    "r8_prevalence_baseline",
    f"""WITH {SCORED} SELECT round(avg(y), 8) AS prevalence, round(greatest(avg(y), 1 - avg(y)), 8) AS majority_accuracy, round(count(*) FILTER ((o_totalprice > 250000) = (y = 1))::DOUBLE / count(*), 8) AS rule_accuracy FROM x""",
)
def _(t):
    out = ft.prevalence_baseline(scored(t), "y", F.col("o_totalprice") > 250000)
    return out.select(*rnd("prevalence", "majority_accuracy", "rule_accuracy", n=8))


@query(
    "r9_auc",
    f"""WITH {SCORED}, c AS (SELECT p, count(*) AS n, sum(y) AS pos FROM x GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY p) - n + (n + 1) / 2.0 AS rk, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM c), t AS (SELECT sum(pos)::DOUBLE AS n1, (sum(n) - sum(pos))::DOUBLE AS n0 FROM c)
        SELECT round((sum(pos * rk)::DOUBLE - any_value(n1 * (n1 + 1) / 2)) / any_value(n1 * n0), 8) AS auc_roc, round(sum(pos * cp::DOUBLE / cn) / any_value(n1), 8) AS auc_pr FROM r, t""",
)
def _(t):
    return ft.auc(scored(t), "y", "p").select(*rnd("auc_roc", "auc_pr", n=8))


CM = "count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn"


@query(
    "r10_confusion_metrics",
    f"""WITH {SCORED}, m AS (SELECT {CM} FROM x) SELECT *, round(tp::DOUBLE / (tp + fp), 8) AS precision, round(tp::DOUBLE / (tp + fn), 8) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 8) AS f1, round(5.0::DOUBLE * tp / (5 * tp + 4 * fn + fp), 8) AS f_beta, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 8) AS accuracy FROM m""",
)
def _(t):
    out = ft.classification_metrics(scored(t), "y", "p")
    return out.select("tp", "fp", "fn", "tn", *rnd("precision", "recall", "f1", "f_beta", "accuracy", n=8))


@query(
    "r11_precision_at_k",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY y DESC, o_orderkey) AS ir FROM x),
             g AS (SELECT o_orderpriority, sum(y) FILTER (r <= 50) AS hits, sum(y / log2(r + 1)) FILTER (r <= 50) AS dcg, sum(y / log2(ir + 1)) FILTER (ir <= 50) AS idcg, sum(y) AS pos, count(*) AS n FROM r GROUP BY 1)
        SELECT o_orderpriority, round(hits::DOUBLE / 50, 8) AS precision_at_k, round(hits::DOUBLE / pos, 8) AS recall_at_k, round((hits::DOUBLE / 50) / (pos::DOUBLE / n), 8) AS lift_at_k, round(dcg / idcg, 8) AS ndcg_at_k FROM g""",
)
def _(t):
    out = ft.at_k(scored(t), ["o_orderpriority"], "y", "p", "o_orderkey", 50)
    return out.select("o_orderpriority", *rnd("precision_at_k", "recall_at_k", "lift_at_k", "ndcg_at_k", n=8))


@query(
    "r12_regression_metrics",
    f"""WITH {BASE}, e AS (SELECT *, n - moving_average AS e FROM b WHERE moving_average IS NOT NULL)
        SELECT k, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * avg(abs(e) / n), 6) AS mape, round(1 - sum(e * e) / (var_pop(n) * count(*)), 6) AS r2, round(100 * sum(abs(e)) / sum(n), 6) AS wape, round(avg(abs(e)) / avg(abs(n - last_value)), 6) AS mase FROM e GROUP BY 1""",
)
def _(t):
    base = ft.baselines(series(t), ["k"], "day", "n")
    out = ft.regression_metrics(base, "n", "moving_average", ["k"], naive="last_value")
    return out.select("k", "n", *rnd("mae", "rmse", "mape", "r2", "wape", "mase"))


@query(
    "r13_best_threshold",
    f"""WITH {SCORED}, c AS (SELECT cut, count(*) FILTER (y = 0 AND least(99, floor(p * 100 + 1e-9)) >= cut) AS fp, count(*) FILTER (y = 1 AND least(99, floor(p * 100 + 1e-9)) < cut) AS fn FROM x, range(1, 100) r(cut) GROUP BY 1)
        SELECT cut / 100.0::DOUBLE AS threshold, (fp * 10 + fn * 20)::DOUBLE AS cost, fp, fn FROM c ORDER BY fp * 10 + fn * 20, cut LIMIT 1""",
)
def _(t):
    return ft.best_threshold(scored(t), "y", "p", 10, 20)


@query(
    "r14_calibration",
    f"WITH {SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed_rate FROM x GROUP BY 1",
)
def _(t):
    return ft.calibration(scored(t), "y", "p").select("bin", "n", *rnd("mean_score", "observed_rate"))


@query("r14_brier", f"WITH {SCORED} SELECT o_orderpriority, round(avg(pow(p - y, 2)), 8) AS brier FROM x GROUP BY 1")
def _(t):
    return ft.brier(scored(t), "y", "p", ["o_orderpriority"]).withColumn("brier", F.round("brier", 8))


@query("r14_isotonic")
def _(t):
    x = scored(t)
    return ft.brier(ft.isotonic(x, x, "y", "p"), "y", "calibrated", ["o_orderpriority"])


@query(
    "r15_slice_metrics",
    f"""WITH {SCORED}, c AS (SELECT o_orderpriority AS s, p, count(*) AS n, sum(y) AS pos FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY p) - n + (n + 1) / 2.0 AS rk FROM c),
             a AS (SELECT s, (sum(pos * rk)::DOUBLE - sum(pos)::DOUBLE * (sum(pos) + 1) / 2) / (sum(pos)::DOUBLE * (sum(n) - sum(pos))) AS auc FROM r GROUP BY 1),
             m AS (SELECT o_orderpriority AS s, {CM} FROM x GROUP BY 1)
        SELECT 'o_orderpriority' AS slice, s AS member, round(auc, 8) AS auc_roc, round(tp::DOUBLE / (tp + fp), 8) AS precision, round(tp::DOUBLE / (tp + fn), 8) AS recall FROM a JOIN m USING (s)""",
)
def _(t):
    out = ft.slice_metrics(scored(t), "y", "p", ["o_orderpriority"])
    return out.select("slice", "member", *rnd("auc_roc", "precision", "recall", n=8))


@query(
    "r16_fairness",
    f"""WITH {SCORED}, g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (p >= 0.5)::DOUBLE / count(*) AS s, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE / sum(y) AS t, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE / count(*) FILTER (y = 0) AS f FROM x GROUP BY 1)
        SELECT o_orderpriority, n, round(s, 8) AS selection_rate, round(t, 8) AS tpr, round(f, 8) AS fpr, round(max(s) OVER () - s, 8) AS parity_gap, round(greatest(max(t) OVER () - t, f - min(f) OVER ()), 8) AS equalised_odds_gap FROM g""",
)
def _(t):
    out = ft.fairness(scored(t), "o_orderpriority", "y", F.col("p") >= 0.5)
    return out.select("o_orderpriority", "n", *rnd("selection_rate", "tpr", "fpr", "parity_gap", "equalised_odds_gap", n=8))


XS = ["p", "o_totalprice"]


@query("r17_fit_linear")
def _(t):
    x = scored(t)
    return ft.auc(ft.score(ft.fit_classifier(x, "y", XS), x, "s"), "y", "s")


@query("r17_mean_score", f"WITH {SCORED} SELECT count(*) AS n, count(*) AS n_scored, round(avg(y), 3) AS mean_score FROM x")
def _(t):
    """An unpenalised logistic fit reproduces the share of ones."""
    x = scored(t)
    s = ft.score(ft.fit_classifier(x, "y", XS), x, "s")
    return s.agg(F.count("*").alias("n"), F.count("s").alias("n_scored"), F.round(F.avg("s"), 3).alias("mean_score"))


@query("r17_fit_boosted")
def _(t):
    x = scored(t)
    return ft.auc(ft.score(ft.fit_classifier(x, "y", XS, "boosted"), x, "s"), "y", "s")


@query("r18_adversarial_validation")
def _(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    xs = ["l_quantity", "l_extendedprice", "l_discount"]
    return ft.adversarial_auc(t.lineitem.filter(F.col("l_shipdate") < cut), t.lineitem.filter(F.col("l_shipdate") >= cut), xs)


@query("r18_separable", "SELECT 1.0::DOUBLE AS auc_roc, true AS is_drifted")
def _(t):
    """Two samples that a feature separates are told apart without an error."""
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    df = t.lineitem.withColumn("day", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double"))
    out = ft.adversarial_auc(df.filter(F.col("l_shipdate") < cut), df.filter(F.col("l_shipdate") >= cut), ["day"])
    return out.select(F.round("auc_roc", 6).alias("auc_roc"), "is_drifted")


def written_scores(t):
    """Key, label and features, written once: the fit and every permutation read them, and their hashes cost more than that."""
    return settle(scored(t).select("o_orderkey", "y", *XS), "scored")


@query("r19_constant_feature", "SELECT 'flat' AS feature, 0.0::DOUBLE AS auc_drop")
def _(t):
    """A feature with one value is worth nothing, whatever the others are worth."""
    x = written_scores(t).withColumn("flat", F.lit(7.0))
    out = ft.permutation_importance(ft.fit_classifier(x, "y", [*XS, "flat"]), x, "o_orderkey", "y", [*XS, "flat"])
    return out.filter("feature = 'flat'").select("feature", F.round("auc_drop", 9).alias("auc_drop"))


@query("r19_permutation_importance")
def _(t):
    x = written_scores(t)
    return ft.permutation_importance(ft.fit_classifier(x, "y", XS), x, "o_orderkey", "y", XS)


@query("r19_label_permutation")
def _(t):
    return ft.label_permutation_auc(scored(t), "o_orderkey", "y", XS)


@query("r20_cluster_outcomes")
def _(t):
    spend = t.orders.groupBy("o_custkey").agg(fx.money_sum("o_totalprice").alias("spend"), F.count("*").cast("double").alias("n_orders"))
    df = spend.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return ft.cluster_outcomes(df, ["spend", "n_orders"], 4, "c_acctbal")


@query(
    "r20_cluster_totals",
    """SELECT 4 AS n_clusters, count(*) AS n, round(avg(c_acctbal), 4) AS mean_outcome, round(avg(n_orders), 6) AS mean_orders
       FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    """Sizes and means of the clusters add up to those of all customers."""
    spend = t.orders.groupBy("o_custkey").agg(fx.money_sum("o_totalprice").alias("spend"), F.count("*").cast("double").alias("n_orders"))
    df = spend.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = ft.cluster_outcomes(df, ["spend", "n_orders"], 4, "c_acctbal")
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return g.agg(
        F.count("cluster").cast("int").alias("n_clusters"), F.sum("n").alias("n"), F.round(weighted("mean_outcome"), 4).alias("mean_outcome"),
        F.round(weighted("mean_n_orders"), 6).alias("mean_orders"),
    )


@query(
    "r21_batch_scores",
    "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice <= 200000) AS n_scored FROM orders GROUP BY 1",
)
def _(t):
    """Every row is kept; a row with an unknown feature has no score, the others have one between 0 and 1."""
    x = scored(t)
    model = ft.fit_classifier(x, "y", XS)
    holed = x.withColumn("o_totalprice", F.when(F.col("o_totalprice") <= 200000, F.col("o_totalprice")))
    s = ft.score(model, holed, "s")
    return s.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count(F.when(F.col("s").between(0, 1), 1)).alias("n_scored"))


@query("r21_score_drift")
def _(t):
    x = scored(t)
    s = ft.score(ft.fit_classifier(x, "y", XS), x, "s")
    return dr.psi(s.filter("o_orderpriority <> '1-URGENT'"), s.filter("o_orderpriority = '1-URGENT'"), "s")
