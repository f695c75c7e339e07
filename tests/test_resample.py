"""Split counts against resamples of single rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resample as rs
from tidemark.operators import stats as st


def skewed(n=3000, seed=5):
    """Heavy-tailed values with a tie that holds a third of the rows."""
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n) < 0.33, 2.0, np.round(rng.lognormal(1, 1.2, n), 3))


def described(x):
    return [x.mean(), x.std(ddof=1), *np.percentile(x, [2.5, 50, 97.5])]


@pytest.mark.parametrize("stat, function", [("mean", np.mean), ("sum", np.sum), ("median", np.median)])
def test_bootstrap_has_the_distribution_of_resampled_rows(spark, stat, function):
    v = skewed()
    if stat == "median":
        v = np.random.default_rng(6).lognormal(1, 1.2, 2001)
    rng = np.random.default_rng(7)
    rows = rng.poisson(1, (6000, len(v))) if stat == "sum" else rng.multinomial(len(v), [1 / len(v)] * len(v), 6000)
    want = np.array([function(np.repeat(v, w)) for w in rows])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = rs.bootstrap_medians(df, "v", 10_000, 42) if stat == "median" else rs.bootstrap_totals(df, "v", stat, 10_000, 42)
    got = got.toPandas().stat.to_numpy()
    assert len(got) == 10_000
    spread = want.std()
    for a, b in zip(described(got), described(want)):
        assert abs(a - b) < 0.12 * spread


@pytest.mark.parametrize("exact", [True, False])
def test_arms_have_the_distribution_of_dealt_rows(spark, exact):
    v, taken = skewed(2000), 700
    rng = np.random.default_rng(8)
    order = np.argsort(rng.random((6000, len(v))), axis=1)[:, :taken] if exact else None
    want = v[order].sum(axis=1) if exact else np.array([v[rng.random(len(v)) < taken / len(v)].sum() for _ in range(6000)])
    got = rs.arm_sums(spark.createDataFrame(pd.DataFrame({"v": v})), "v", taken, 10_000, 42, exact).toPandas()
    if exact:
        assert (got["size"] == taken).all()
    assert got["size"].mean() == pytest.approx(taken, rel=0.002)
    for a, b in zip(described(got.total.to_numpy()), described(want)):
        assert abs(a - b) < 0.12 * want.std()


def test_p_value_is_that_of_relabelled_rows(spark):
    rng = np.random.default_rng(9)
    v, b = rng.lognormal(0, 1, 1500), rng.random(1500) < 0.3
    v = v + 0.12 * b
    obs = abs(v[b].mean() - v[~b].mean())
    labels = np.array([rng.permutation(b) for _ in range(6000)])
    sums = labels @ v
    d = np.abs(sums / b.sum() - (v.sum() - sums) / (~b).sum())
    want = (np.count_nonzero(d >= obs) + 1) / 6001
    df = spark.createDataFrame(pd.DataFrame({"v": v, "b": b}))
    for exact in (True, False):
        row = st.permutation_test(df, F.col("b"), "v", exact=exact).first()
        assert row["n_permutations"] == 10_000 and row["p_value"] == pytest.approx(want, abs=0.02)


def test_work_follows_replicates_not_rows(spark):
    """A hundred times the rows give the same number of leaves, and intervals a tenth as wide."""
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).cast("double").alias("v"))
    many = df.crossJoin(spark.range(100)).select("v")
    assert rs.value_leaves(many, "v").count() == rs.value_leaves(df, "v").count() == rs.LEAVES
    one, hundred = (st.bootstrap_ci(x, "v", n=2000).first() for x in (df, many))
    assert hundred.boot_se == pytest.approx(one.boot_se / 10, rel=0.1)


def test_edges(spark):
    none = spark.createDataFrame([(None,)], "v double")
    for stat in ("mean", "sum", "median"):
        assert st.bootstrap_ci(none, "v", stat, 50).first()["boot_mean"] is None
    same = spark.createDataFrame([(3.0,)] * 40 + [(None,)], "v double")
    assert [st.bootstrap_ci(same, "v", s, 50).first()["ci_high"] for s in ("mean", "median")] == [3.0, 3.0]
    with pytest.raises(ValueError, match="both arms"):
        st.permutation_test(same, F.lit(True), "v")
    with pytest.raises(ValueError, match="power of two"):
        rs.arm_sums(same, "v", 3, 10, 1, True, leaves=12)
