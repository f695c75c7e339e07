"""Distribution functions on published values, tests on planted effects."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.functions import distributions as ds
from tidemark.operators import drift as dr
from tidemark.operators import features as ft
from tidemark.operators import stats as st


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "build, want, tol",
    [
        (lambda: ds.normal_cdf(F.lit(1.959963984540054)), 0.975, 2e-7),
        (lambda: ds.normal_quantile(F.lit(0.975)), 1.959963984540054, 1e-7),
        (lambda: ds.normal_quantile(F.lit(0.001)), -3.090232306167813, 1e-7),
        (lambda: ds.t_two_sided(F.lit(2.2281388519649385), F.lit(10.0)), 0.05, 1e-9),
        (lambda: ds.t_quantile(F.lit(0.975), F.lit(10.0)), 2.2281388519649385, 1e-7),
        (lambda: ds.f_tail(F.lit(4.0), F.lit(1.0), F.lit(10.0)), 0.07338803477074039, 1e-9),
        (lambda: ds.chi2_tail(F.lit(3.841458820694124), F.lit(1.0)), 0.05, 1e-9),
        (lambda: ds.chi2_tail(F.lit(18.307038053275146), F.lit(10.0)), 0.05, 1e-9),
        (lambda: ds.beta_quantile(F.lit(0.025), F.lit(5.0), F.lit(6.0)), 0.18708602844739853, 1e-7),
        (lambda: ds.kolmogorov_sf(F.lit(1.3580986393225507)), 0.05, 1e-6),
    ],
)
def test_distribution_values(spark, build, want, tol):
    assert value(spark, build()) == pytest.approx(want, abs=tol)


def test_adjusted_p_values(spark):
    ps = [0.001, 0.012, 0.031, 0.048, 0.071, 0.11]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    bh = {r.p: r.p_adjusted for r in st.adjust_p(df, "p").collect()}
    assert [round(bh[p], 6) for p in ps] == [0.006, 0.036, 0.062, 0.072, 0.0852, 0.11]
    bonf = {r.p: r.p_adjusted for r in st.adjust_p(df, "p", "bonferroni").collect()}
    assert [round(bonf[p], 6) for p in ps] == [0.006, 0.072, 0.186, 0.288, 0.426, 0.66]


def test_simpson_reversal(spark):
    cells = [(1, "s", 81, 87), (1, "l", 192, 263), (0, "s", 234, 270), (0, "l", 55, 80)]
    rows = [(t, s, 1 if i < x else 0) for t, s, x, n in cells for i in range(n)]
    df = spark.createDataFrame(rows, "t int, s string, y int")
    r = st.simpson(df, F.col("t") == 1, "y", ["s"]).first()
    assert r.is_simpson and r.sign_flips and r.aggregate_effect < 0 < r.adjusted_effect


def arms(spark, shift=0.0, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(2 * n), "b": np.repeat([False, True], n)})
    pdf["y"] = rng.normal(10, 2, 2 * n) + shift * pdf.b
    pdf["x"] = rng.normal(0, 1, 2 * n)
    return pdf, spark.createDataFrame(pdf)


def test_planted_effect_and_null(spark):
    _, df = arms(spark, 0.5)
    r = st.ab_test(df, F.col("b"), "y", 0.2).first()
    assert r.decision == "act" and r.ci_low < 0.5 < r.ci_high and r.p_value < 1e-6
    _, same = arms(spark, 0.0)
    assert st.welch(same, F.col("b"), "y").first()["p_value"] > 0.01
    assert st.mann_whitney(df, F.col("b"), "y").first()["p_value"] < 1e-6
    assert st.permutation_test(df, F.col("b"), "y", 60).first()["p_value"] == pytest.approx(1 / 61)
    assert st.permutation_test(same, F.col("b"), "y", 60, exact=False).first()["p_value"] > 0.01


def test_bootstrap_covers_and_repeats(spark):
    pdf, df = arms(spark)
    a, again = (st.bootstrap_ci(x, "y").first() for x in (df, df.repartition(5)))
    assert list(a) == pytest.approx(list(again), rel=1e-9)
    se = pdf.y.std() / np.sqrt(len(pdf))
    assert a.ci_low < pdf.y.mean() < a.ci_high and a.boot_se == pytest.approx(se, rel=0.04)
    m = st.bootstrap_ci(df, "y", "median").first()
    assert m.ci_low <= np.median(pdf.y) <= m.ci_high


def test_ols_matches_library_and_hc3(spark):
    pdf, df = arms(spark, 0.0)
    df = df.withColumn("y", 3 + 2 * F.col("x") + (F.col("y") - 10) * (1 + F.abs("x"))).withColumn("z", F.col("id") % 7)
    mine = {r.term: r for r in st.ols(df, "y", ["x", "z"]).collect()}
    data = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(df)
    fit = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(data)
    assert mine["x"].estimate == pytest.approx(fit.coefficients[0], rel=1e-8)
    assert mine["intercept"].estimate == pytest.approx(fit.intercept, rel=1e-8)
    assert mine["z"].std_error == pytest.approx(fit.summary.coefficientStandardErrors[1], rel=1e-8)
    assert mine["x"].p_value == pytest.approx(fit.summary.pValues[0], abs=1e-9)
    p = df.toPandas()
    X = np.column_stack([np.ones(len(p)), p.x, p.z])
    inv = np.linalg.inv(X.T @ X)
    e = p.y - X @ (inv @ X.T @ p.y)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    cov = inv @ (X * ((e / (1 - h)) ** 2).values[:, None]).T @ X @ inv
    robust = {r.term: r.std_error for r in st.ols(df, "y", ["x", "z"], robust=True).collect()}
    assert [robust[t] for t in ("intercept", "x", "z")] == pytest.approx(list(np.sqrt(np.diag(cov))), rel=1e-7)


def test_fisher_and_intervals(spark):
    t = spark.createDataFrame([(8, 2, 1, 5)], "a long, b long, c long, d long")
    assert st.fisher_exact(t).first()["p_value"] == pytest.approx(0.03496503496503495, rel=1e-9)
    df = spark.createDataFrame([(i < 5,) for i in range(10)], "f boolean")
    r = st.proportion_ci(df, [], F.col("f")).first()
    assert (r.ci_low, r.ci_high) == pytest.approx((0.1870860284, 0.8129139716), abs=1e-7)
    m = st.mean_ci(spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double"), [], "v").first()
    assert (m.ci_low, m.ci_high) == pytest.approx((3.3341494103866087, 7.665850589613392), abs=1e-6)


def test_matching_recovers_effect(spark):
    from pyspark.sql import Observation

    seen = Observation("metrics before a model fit must not break scoring")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(0, 1, n)
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    y = 2 * x + 1.5 * t + rng.normal(0, 0.5, n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "t": t, "y": y, "x": x}))
    assert st.psm_att(df, "id", "t", "y", ["x"]).first()["att"] == pytest.approx(1.5, abs=0.15)


def test_psi_and_ks_against_numpy(spark):
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(0, 1, 4000), 2), np.round(rng.normal(0.3, 1.1, 3000), 2)
    da, db = (spark.createDataFrame(pd.DataFrame({"v": z})) for z in (a, b))
    cuts = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    e, c = np.histogram(a, cuts)[0] / len(a), np.histogram(b, cuts)[0] / len(b)
    strict = dr.psi(da, db, "v", strict_reference=True).first()["psi"]
    assert strict == pytest.approx(float(np.sum((c - e) * np.log(c / e))), rel=1e-9)
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), grid, "right") / len(a), np.searchsorted(np.sort(b), grid, "right") / len(b)
    assert dr.ks2(da, db, "v").first()["statistic"] == pytest.approx(np.abs(fa - fb).max())
    assert dr.wasserstein(da, db, "v").first()["distance"] == pytest.approx(float(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))))
    assert dr.psi(da, da, "v").first()["psi"] == 0


def test_model_sanity(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 1000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1000), "x": x, "noise": rng.normal(0, 1, 1000), "y": (x > 0).astype(int)}))
    model = ft.fit_classifier(df, "y", ["x", "noise"])
    assert ft.auc(ft.score(model, df), "y", "p").first()["auc_roc"] > 0.99
    drops = {r.feature: r.auc_drop for r in ft.permutation_importance(model, df, "id", "y", ["x", "noise"]).collect()}
    assert drops["x"] > 0.3 and abs(drops["noise"]) < 0.05
    assert abs(ft.label_permutation_auc(df, "id", "y", ["x", "noise"]).first()["auc_roc"] - 0.5) < 0.08
    shuffled = ft.shuffled_column(df, "id", "x", 1).toPandas()
    assert sorted(shuffled.x) == sorted(x) and (shuffled.sort_values("id").x.values != x).mean() > 0.9


def test_permutation_writes_no_rows(spark):
    """The shuffled column is that of the two hash orders; it takes the counts of hash parts, not written ranges of rows."""
    from pyspark.sql import functions as F

    from tidemark import session

    df = spark.range(0, 3000, 3).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("y"))
    n = len(session._settled)
    got = {r["id"]: r["x"] for r in ft.shuffled_column(df, "id", "x", 5).collect()}
    rows = df.select("id", "x", F.xxhash64("id", F.lit(5)).alias("a"), F.xxhash64("id", F.lit(6)).alias("b")).collect()
    want = dict(zip([r["id"] for r in sorted(rows, key=lambda r: (r["a"], r["id"]))], [r["x"] for r in sorted(rows, key=lambda r: (r["b"], r["id"]))]))
    assert got == want
    both = df.withColumn("x", F.when(F.col("id") % 5 > 0, F.col("x")))
    assert ft.auc_roc(both, "y", "x").first()[0] == ft.auc(both, "y", "x").first()["auc_roc"]
    assert ft.auc_roc(both.filter("y = 0"), "y", "x").first()[0] is None and ft.auc_roc(both.filter("id < 0"), "y", "x").first()[0] is None
    made = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._settled[n:]]
    assert made[0] == "parts" and made.count("ranges") == 1  # that of auc


def test_label_permutation_writes_its_rows_once(spark):
    from tidemark import session

    df = spark.range(600).selectExpr("id", "CAST(id * 37 % 101 AS DOUBLE) AS x", "CAST(id % 2 AS INT) AS y")
    n = len(session._settled)
    assert abs(ft.label_permutation_auc(df, "id", "y", ["x"]).first()["auc_roc"] - 0.5) < 0.1
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._settled[n:]] == ["parts", "mixed", "ranges"]  # the last one for the scores


def test_importance_scores_orders_once(spark, data):
    """The scores that the query makes of each order are read by the fit and three times per feature."""
    import __spark_entry__ as entry
    from tidemark import session

    n = len(session._settled)
    out = entry.queries()["r19_permutation_importance"](spark, data)
    assert not [f for f in out.inputFiles() if "orders" in f]
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._settled[n:]] == ["scored", "auc", "parts", "parts"]
    drops = {r["feature"]: r["auc_drop"] for r in out.collect()}
    assert drops["p"] > 0.2 and abs(drops["o_totalprice"]) < 0.01


def test_importance_writes_counts_only(spark):
    from tidemark import session

    df = spark.range(600).selectExpr("id", "CAST(id * 37 % 101 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS z", "CAST(id * 37 % 101 > 50 AS INT) AS y")
    model, n = ft.fit_classifier(df, "y", ["x", "z"]), len(session._settled)
    drops = {r["feature"]: r["auc_drop"] for r in ft.permutation_importance(model, df, "id", "y", ["x", "z"]).collect()}
    assert drops["x"] > 0.3 and abs(drops["z"]) < 0.05
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._settled[n:]] == ["auc", "parts", "parts"]


def test_groups_meet_their_figures_without_a_shuffle_of_rows(spark):
    df = spark.range(4000).selectExpr("id % 3 AS g", "CAST(id * 37 % 1009 AS DOUBLE) AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = st.describe_stats(df, ["v"], ["g"])
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [below for i, line in enumerate(lines) if "Exchange hashpartitioning" in line for below in lines[i + 1 : i + 3]]
    assert out.count() == 3 and any("HashAggregate" in x for x in dealt) and not any("Expand" in x for x in dealt)


def test_auc_counts_ties_as_half(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)]
    r = ft.auc(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    assert r.auc_roc == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_tails_of_large_parameters(spark):
    """Values at the mean from the expansion of the median; symmetric beta; normal limit."""
    df = spark.createDataFrame([(10.0**k,) for k in range(2, 10)], "v double")
    got = df.select("v", ds.chi2_tail(F.col("v"), F.col("v")).alias("chi"), ds.f_tail(F.lit(1.0), F.col("v"), F.col("v")).alias("f"),
                    ds.t_two_sided(F.lit(1.959963984540054), F.col("v")).alias("t")).collect()
    for r in got:
        # upper tail at the mean: 1/2 - 1/(3 sqrt(2 pi s)) with s half the degrees of freedom, next term s^-1.5
        s = r.v / 2
        assert r.chi == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * s)) - 1 / (540 * s * math.sqrt(2 * math.pi * s)), abs=1e-9 + 2e-5 / r.v)
        assert r.f == pytest.approx(0.5, abs=1e-9)
        # normal tail plus the first correction of Student t
        x = 1.959963984540054
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        assert r.t == pytest.approx(0.05 + 2 * density * x * (x * x + 1) / (4 * r.v), abs=0.6 / r.v**2 + 1e-9)
    low = spark.range(1).select(ds.t_quantile(F.lit(0.99999), F.lit(1.0)).alias("q")).first().q
    assert low == pytest.approx(math.tan(math.pi * 0.49999), rel=1e-6)


def test_fisher_of_any_margins(spark):
    """Against exact sums of whole-number binomials, and the normal limit where margins are in the millions."""
    from math import comb

    rows = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (40, 60, 55, 45), (7, 7, 7, 7), (1, 0, 0, 1), (200, 10, 120, 90)]
    big = [(1_500_000, 1_500_000, 1_500_000, 1_500_000), (1_501_000, 1_499_000, 1_499_000, 1_501_000), (3_000_000, 10, 10, 3_000_000)]
    got = {(r.a, r.b, r.c, r.d): r.p_value for r in st.fisher_exact(spark.createDataFrame(rows + big, "a long, b long, c long, d long")).collect()}
    for a, b, c, d in rows:
        weights = [comb(a + b, k) * comb(c + d, a + c - k) for k in range(max(0, a - d), min(a + b, a + c) + 1)]
        seen = comb(a + b, a) * comb(c + d, c)
        want = sum(w for w in weights if w <= seen * (1 + 1e-7)) / sum(weights)
        assert got[a, b, c, d] == pytest.approx(want, rel=1e-9)
    assert got[big[0]] == 1.0 and got[big[2]] < 1e-300
    n = 3_000_000
    sd = math.sqrt(n * n * n * n / ((2 * n) ** 2 * (2 * n - 1)))
    assert got[big[1]] == pytest.approx(math.erfc((1000 - 0.5) / sd / math.sqrt(2)), rel=1e-4)


def test_scores_keep_rows_with_unknown_features(spark):
    from tidemark.operators import features as fe

    rows = [(i, float(i % 7), None if i % 10 == 0 else float(i % 3), float("nan") if i % 25 == 0 else 1.0 * (i % 5), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    for kind in ("linear", "boosted"):
        scored = fe.score(fe.fit_classifier(df, "y", ["a", "b", "c"], kind), df)
        assert scored.count() == 200 and scored.filter("p IS NULL").count() == df.filter("b IS NULL OR isnan(c)").count()
    assert fe.left_out(df, ["a", "b", "c"]).first().n_left_out == 24
    assert fe.cluster_outcomes(df, ["a", "b", "c"], 3, "y").agg(F.sum("n")).first()[0] == 200
