"""Edge menu: empty, single row, all NULL, one hot key; results stay whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate as ag
from tidemark.operators import business as bz
from tidemark.operators import dims as dm
from tidemark.operators import drift as dr
from tidemark.operators import features as ft
from tidemark.operators import joins as jn
from tidemark.operators import measures as ms
from tidemark.operators import reconcile as rc
from tidemark.operators import rules as rl
from tidemark.operators import sets as st
from tidemark.operators import shapes as sh
from tidemark.operators import stats as q
from tidemark.operators import windows as wn

SCHEMA = "k string, id long, v double, y int, at timestamp_ntz"
ROWS = {
    "empty": [],
    "single": [("a", 1, 2.0, 1, dt.datetime(2024, 2, 29))],
    "nulls": [(None, None, None, None, None)] * 3,
    "zeros": [("a", i, 0.0, 0, dt.datetime(2024, 1, 1 + i)) for i in range(4)],
}

RUNS = {
    "percentiles": lambda d: ag.percentiles(d, ["k"], "v", {"p": 0.5}),
    "share": lambda d: ag.share_of_total(d, ["k"], "v"),
    "completeness": lambda d: ag.row_completeness(d, ["k", "v"]),
    "value_counts": lambda d: st.value_counts(d, "k", 2),
    "top_others": lambda d: st.top_n_others(d, "k", "v", 1),
    "dedup": lambda d: wn.dedup_latest(d, ["k"], [F.desc("at")]),
    "gaps": lambda d: wn.sequence_gaps(d, ["k"], "id", ["at"]),
    "ranks": lambda d: wn.rank_by(d, ["k"], ["id"], ["rank", "dense_rank", "row_number", "ntile"]),
    "asof": lambda d: jn.asof_join(d, d.select("k", F.col("at").alias("bt"), F.col("v").alias("w")), ["k"], "at", "bt", ["w"]),
    "relationship": lambda d: jn.relationship(d, "k", d, "k", "self"),
    "reconcile": lambda d: rc.reconcile_by(d, d, ["k"], ["v"]),
    "drift": lambda d: rc.relative_drift(d, d, ["k"], "v"),
    "suite": lambda d: rl.run_suite({"t": d}, {"t": [rl.completeness("v"), rl.unique(["id"]), rl.in_range("v", 0, 1)]}),
    "history": lambda d: dm.scd2_from_history(d, "k", ["v"], "at"),
    "snapshot": lambda d: dm.periodic_snapshot(d.filter("at IS NOT NULL"), "k", "at", "v"),
    "daily": lambda d: ms.to_date(ms.daily_series(d, ["k"], "at", "v"), ["k"], "day", "v", "month"),
    "pareto": lambda d: bz.pareto(d, "k", "v"),
    "cohort": lambda d: bz.cohort_retention(d, "id", "at", "v"),
    "legs": lambda d: bz.build_legs(d, "k", "at", "k"),
    "psi_cat": lambda d: dr.psi_cat(d, d, "k"),
    "ks": lambda d: dr.ks2(d, d, "v"),
    "z": lambda d: dr.modified_z(d, "v"),
    "describe": lambda d: q.describe_stats(d, ["v"], ["k"]),
    "two_arm": lambda d: q.two_arm(d, F.col("y") == 1, "v"),
    "auc": lambda d: ft.auc(d, "y", "v"),
    "confusion": lambda d: ft.classification_metrics(d, "y", "v"),
    "calibration": lambda d: ft.calibration(d, "y", "v"),
    "boxplot": lambda d: sh.boxplot_stats(d, ["k"], "v"),
    "ecdf": lambda d: sh.ecdf(d, "v"),
    "bins": lambda d: sh.bins2d(d, "v", "id", 4),
    "downsample": lambda d: sh.downsample(d, "at", "v", 5),
}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Tiny inputs: most of the time would go into empty tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("case", ["empty", "nulls", "zeros"])
def test_edge_menu(spark, case):
    """One session run per case: no operator fails, none invents rows."""
    df = spark.createDataFrame(ROWS[case], SCHEMA)
    for name, run in RUNS.items():
        try:
            rows = run(df).collect()
        except Exception as err:  # noqa: BLE001
            raise AssertionError(f"{name} on {case}: {str(err)[:300]}") from err
        assert len(rows) <= 40, name


STATS = {
    "mean": lambda d: q.one_sample_t(d, "v"),
    "welch": lambda d: q.welch(d, F.col("y") == 1, "v"),
    "rank sum": lambda d: q.mann_whitney(d, F.col("y") == 1, "v"),
    "kruskal": lambda d: q.kruskal(d, "k", "v"),
    "wilcoxon": lambda d: q.wilcoxon(d.withColumn("b", F.col("v")), "v", "b"),
    "proportion": lambda d: q.two_proportion_z(d, F.col("y") == 1, F.col("v") > 0),
    "anova": lambda d: q.anova(d, "k", "v"),
    "chi2": lambda d: q.chi2(d, "k", "y"),
    "effect": lambda d: q.effect_size(d, F.col("y") == 1, "v"),
    "n": lambda d: q.required_n(d, ["k"], "v", 1.0),
    "simpson": lambda d: q.simpson(d, F.col("y") == 1, "v", ["k"]),
    "did": lambda d: q.did(d, F.col("y") == 1, F.col("id") > 1, "v"),
    "loo": lambda d: q.leave_one_out(d, "k", "v"),
    "spearman": lambda d: q.spearman(d, "v", "id"),
    "gof": lambda d: dr.chi2_gof(d, d, "k"),
    "risk": lambda d: q.risk_ratio(d, F.col("y") == 1, F.col("v") > 0),
}


@pytest.mark.parametrize("case", ["empty", "zeros"])
def test_statistics_without_information_give_null(spark, case):
    df = spark.createDataFrame(ROWS[case], SCHEMA)
    for name, run in STATS.items():
        try:
            run(df).collect()
        except Exception as err:  # noqa: BLE001
            raise AssertionError(f"{name} on {case}: {str(err)[:300]}") from err


def test_empty_psi(spark):
    df = spark.createDataFrame([], SCHEMA)
    full = spark.createDataFrame(ROWS["zeros"], SCHEMA)
    assert dr.psi(full, full, "v").first()["psi"] == 0
    assert q.mann_whitney(full, F.col("y") == 1, "v").first()["n_b"] == 0
    assert q.adjust_p(df, "v").count() == 0


def test_hot_key_keeps_results_whole(spark):
    """One key with most rows: sums, ranks, versions and quarantine lose nothing."""
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id",
        (F.col("id") * 7919 % 101).cast("double").alias("v"),
        F.timestamp_seconds(F.col("id") * 977 % n).cast("timestamp_ntz").alias("at"),
    )
    ranks = wn.rank_by(df, ["k"], ["at", "id"], ["row_number"]).groupBy("k").agg(
        F.count("*").alias("n"), F.max("row_number").alias("hi"), F.count_distinct("row_number").alias("d")
    )
    assert all(r.n == r.hi == r.d for r in ranks.collect())
    assert ranks.agg(F.sum("n")).first()[0] == n
    box = sh.boxplot_stats(df, ["k"], "v").filter("k = 'hot'").first()
    want = spark.sql("SELECT 1").crossJoin(df.filter("k = 'hot'").agg(F.percentile("v", F.lit(0.25)).alias("q"))).first()["q"]
    assert box.q1 == want
    hist = dm.scd2_from_history(df, "k", ["v"], "at")
    assert dm.check_scd2(hist, "k").count() == 0
    good, bad = rl.quarantine(df, [rl.in_range("v", 0, 50)])
    assert good.count() + bad.count() == n
    assert bz.pareto(df, "k", "v").agg(F.sum("total")).first()[0] == df.agg(F.sum("v")).first()[0]
