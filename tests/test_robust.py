"""Planted missingness, masked outliers and spoiled seasons."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import robust as rb


def plain_little(x):
    """Row-wise EM and Little's statistic in numpy."""
    n, k = x.shape
    mean, cov = np.nanmean(x, 0), np.diag(np.nanvar(x, 0))
    for _ in range(3000):
        filled, extra = x.copy(), np.zeros((k, k))
        for i in range(n):
            m = np.isnan(x[i])
            if m.any():
                o = ~m
                b = cov[np.ix_(m, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
                filled[i, m] = mean[m] + b @ (x[i, o] - mean[o])
                extra[np.ix_(m, m)] += cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)]
        fresh = filled.mean(0)
        spread = (filled - fresh).T @ (filled - fresh) / n + extra / n
        if max(abs(fresh - mean).max(), abs(spread - cov).max()) < 1e-11:
            break
        mean, cov = fresh, spread
    out, masks = 0.0, [tuple(m) for m in ~np.isnan(x)]
    for mask in set(masks):
        o = np.array(mask)
        rows = x[[i for i, m in enumerate(masks) if m == mask]][:, o]
        gap = rows.mean(0) - mean[o]
        out += len(rows) * gap @ np.linalg.inv(cov[np.ix_(o, o)]) @ gap
    return out, sum(sum(m) for m in set(masks)) - k, len(set(masks))


def sample(n, seed, dependent):
    rng = np.random.default_rng(seed)
    x = rng.multivariate_normal([1000, 5, -3], [[4, 1.5, 0], [1.5, 2, 0.7], [0, 0.7, 1]], n)
    holes = rng.random((n, 3)) < 0.2
    holes[:, 2] = False
    if dependent:
        holes[:, 0] = x[:, 2] > -2.5
    x[holes] = np.nan
    return x


def test_little_tells_random_from_dependent_holes(spark):
    for dependent in (False, True):
        x = sample(250, 3, dependent)
        df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).replace(float("nan"), None)
        row = rb.littles_test(df, list("abc")).first()
        statistic, free, patterns = plain_little(x)
        assert (row["n"], row["df"], row["n_patterns"]) == (250, free, patterns)
        assert row["statistic"] == pytest.approx(statistic, rel=1e-5)
        assert row["p_value"] < 1e-6 if dependent else row["p_value"] > 0.01
    whole = rb.littles_test(df.na.drop(), list("abc")).first()
    assert (whole["df"], whole["p_value"]) == (0, None)
    with pytest.raises(ValueError, match="at most"):
        rb.littles_test(df, list("a" * 17))


def test_clusters_that_mask_each_other_are_found(spark):
    rng = np.random.default_rng(4)
    good = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 1500)
    bad = rng.normal([6, -6], 0.3, (350, 2))
    x = np.vstack((good, bad)) + 1e6
    pdf = pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(-1, None, 1.0)], "id long, a double, b double"))
    got = rb.robust_distances(df, ["a", "b"]).toPandas().set_index("id")
    assert got.loc[1500:].is_outlier.all()
    share = got.loc[0:1499].is_outlier.mean()
    assert 0.01 < share < 0.05 and got.loc[-1].is_outlier is None
    inv = np.linalg.inv(np.cov(x.T))
    classical = np.einsum("ij,jk,ik->i", x - x.mean(0), inv, x - x.mean(0))
    assert (classical[1500:] > rb.chi2_quantile(0.975, 2)).mean() < 0.9  # they do mask each other
    with pytest.raises(ValueError, match="one value"):
        rb.robust_distances(df.withColumn("flat", F.lit(1.0)), ["a", "flat"])


def test_chi2():
    assert rb.chi2_cdf(7.377758908227871, 2) == pytest.approx(0.975, abs=1e-12)
    assert rb.chi2_quantile(0.95, 10) == pytest.approx(18.307038053275146, rel=1e-9)
    assert rb.chi2_quantile(0.5, 1) == pytest.approx(0.454936423119572, rel=1e-9)


def test_outliers_leave_trend_and_season_alone(spark):
    rng = np.random.default_rng(5)
    days = np.arange(140)
    season = np.array([0, 3, 5, 2, -1, -4, -5.0])
    epoch = dt.date(2024, 1, 1)
    phase = [(epoch - dt.date(1970, 1, 1)).days + int(d) for d in days]
    truth = 100 + 0.3 * days + season[np.array(phase) % 7]
    y = truth + rng.normal(0, 0.3, 140)
    spoiled = rng.choice(np.arange(10, 130), 12, replace=False)
    y[spoiled] += rng.choice([-60, 80], 12)
    rows = [("k", epoch + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, y)] + [("none", epoch, None), ("one", epoch, 4.0)]
    df = spark.createDataFrame(rows, "k string, day date, v double")
    got = rb.robust_decompose(df, ["k"], "day", "v", 7).toPandas()
    one = got[got.k == "one"].iloc[0]
    assert (one.trend, one.residual) == (4.0, 0.0) and np.isnan(got[got.k == "none"].iloc[0].residual)
    own = got[got.k == "k"].sort_values("day")
    error = np.abs(own.trend + own.seasonal - truth)
    plain = dr.decompose(df.filter("k = 'k'"), ["k"], "day", "v", 7).toPandas().sort_values("day")
    missed = np.abs(plain.trend + plain.seasonal - truth)[5:-5]
    assert error.max() < 1.0 < 4 < missed.max()
    assert set(np.flatnonzero(own.weight.to_numpy() == 0)) == set(spoiled)
