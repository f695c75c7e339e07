"""Robust multivariate and seasonal statistics: a few aggregates or window passes, no solver per group.

* ``littles_test``: are values missing completely at random? One row of sums per pattern of
  missing columns, an EM fit of mean and covariance on those rows, Little's statistic.
* ``robust_distances``: Mahalanobis distances by concentration steps, so that clusters of
  outliers can't hide each other; each step is one aggregate and one quantile.
* ``robust_decompose``: trend and season by weighted local lines and bisquare weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.distributions import chi2_tail
from tidemark.operators.ordered import beside
from tidemark.operators.windows import day_number
from tidemark.session import settle

MOST_COLUMNS = 16  # 2 to this power bounds the patterns, which are fitted on the driver
# Bisquare cut-off in medians of the absolute residuals; share below which a distance is no outlier.
BISQUARE_CUT = 6.0
OUTLIER_SHARE = 0.975


def chi2_cdf(x: float, df: float) -> float:
    """Chi-square distribution function by the series or continued fraction of the incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, df + 40 * math.sqrt(2 * df) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


# --- missing completely at random -----------------------------------------------------


def pattern_sums(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], list[dict]]:
    """The columns' means, and per pattern of known columns: n, sums and cross products about those means."""
    if len(cols) > MOST_COLUMNS:
        raise ValueError(f"at most {MOST_COLUMNS} columns, since each pattern of missing ones is a row on the driver")
    x = [F.col(c).cast("double") for c in cols]
    centre = [v or 0.0 for v in df.agg(*[F.avg(c) for c in x]).first()]
    known = [c.isNotNull() for c in x]
    wide = df.select(F.concat(*[F.when(k, "1").otherwise("0") for k in known]).alias("pattern"), *[(c - m).alias(f"x{i}") for i, (c, m) in enumerate(zip(x, centre))])
    k = range(len(cols))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in k]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in k for j in k if i <= j]
    rows = wide.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()  # 2 ** len(cols) rows at most
    out = []
    for r in sorted(rows, key=lambda r: r["pattern"]):
        seen = np.array([i for i in k if r["pattern"][i] == "1"], dtype=int)
        s = np.array([r[f"s{i}"] for i in seen])
        c = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in seen] for i in seen]).reshape(len(seen), len(seen))
        out.append({"n": r["n"], "seen": seen, "sum": s, "cross": c})
    return centre, out


def em_moments(patterns: Sequence[dict], k: int, steps: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a normal sample with missing values, by EM on the pattern sums."""
    n = sum(p["n"] for p in patterns)
    mean, cov = np.zeros(k), np.eye(k)
    for i in range(k):
        own = [p for p in patterns if i in p["seen"]]
        at = [int(np.flatnonzero(p["seen"] == i)[0]) for p in own]
        size = sum(p["n"] for p in own)
        if size:
            cov[i, i] = max(sum(p["cross"][a, a] for p, a in zip(own, at)) / size, 1e-12)
    for _ in range(steps):
        first, second = np.zeros(k), np.zeros((k, k))
        for p in patterns:
            o = p["seen"]
            m = np.setdiff1d(np.arange(k), o)
            b = np.linalg.solve(cov[np.ix_(o, o)], cov[np.ix_(o, m)]).T if len(o) else np.zeros((len(m), 0))
            a = mean[m] - b @ mean[o]
            s, c = p["sum"], p["cross"]
            first[o] += s
            first[m] += p["n"] * a + b @ s
            second[np.ix_(o, o)] += c
            cross = np.outer(a, s) + b @ c
            second[np.ix_(m, o)] += cross
            second[np.ix_(o, m)] += cross.T
            guess = p["n"] * np.outer(a, a) + np.outer(a, b @ s) + np.outer(b @ s, a) + b @ c @ b.T
            second[np.ix_(m, m)] += guess + p["n"] * (cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)])
        fresh = first / n
        spread = second / n - np.outer(fresh, fresh)
        moved = max(np.abs(fresh - mean).max(), np.abs(spread - cov).max() / max(1e-300, np.abs(spread).max()))
        mean, cov = fresh, spread
        if moved < tolerance:
            break
    return mean, cov


def littles_test(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, n_patterns, statistic, df and p_value; small p speaks against values missing completely at random.

    Rows without any known value tell nothing and are left out. One pattern alone gives df 0 and no p value.
    """
    _, patterns = pattern_sums(df, cols)
    patterns = [p for p in patterns if len(p["seen"])]
    k = len(cols)
    statistic, free = 0.0, sum(len(p["seen"]) for p in patterns) - len({i for p in patterns for i in p["seen"]})
    if patterns and free > 0:
        mean, cov = em_moments(patterns, k)
        for p in patterns:
            gap = p["sum"] / p["n"] - mean[p["seen"]]
            statistic += p["n"] * gap @ np.linalg.solve(cov[np.ix_(p["seen"], p["seen"])], gap)
    row = (sum(p["n"] for p in patterns), len(patterns), float(statistic), free)
    out = df.sparkSession.createDataFrame([row], "n long, n_patterns int, statistic double, df int")
    return out.withColumn("p_value", F.when(F.col("df") > 0, chi2_tail(F.col("statistic"), F.greatest(F.col("df"), F.lit(1)).cast("double"))))


# --- multivariate outliers ----------------------------------------------------------------


def _distance(x: Sequence[Column], centre: np.ndarray, inverse: np.ndarray) -> Column:
    gaps = [c - F.lit(float(m)) for c, m in zip(x, centre)]
    total = F.lit(0.0)
    for i, a in enumerate(gaps):
        for j, b in enumerate(gaps):
            if i <= j:
                total = total + a * b * F.lit(float(inverse[i, j] * (1 if i == j else 2)))
    return total


def robust_distances(df: DataFrame, cols: Sequence[str], keep: float = 0.5, steps: int = 30) -> DataFrame:
    """The rows with ``distance`` (squared) and ``is_outlier``; rows with an unknown value have NULL in both.

    It starts from the half nearest to the medians, in units of the MAD, and repeats: moments of
    the kept half, distances of all rows, the nearest ``keep`` of them, until the
    covariance shrinks no more. The covariance is then scaled to be consistent for normal
    data, and once more estimated from the rows that are no outliers under it.
    """
    p = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    names = [f"x{i}" for i in range(p)]
    rows = settle(df.select(*[c.alias(n) for c, n in zip(x, names)]).na.drop(), "complete")  # read twice a step
    n = rows.count()
    if n <= 2 * p:
        raise ValueError(f"{n} complete rows are too few for {p} columns")
    share = max(keep, (n + p + 1) / (2 * n))
    middle = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10_000))
    mid = list(rows.agg(*[middle(F.col(c)) for c in names]).first())
    mad = list(rows.agg(*[middle(F.abs(F.col(c) - m)) for c, m in zip(names, mid)]).first())
    if not all(mad):
        raise ValueError(f"half of the rows have one value in {cols[mad.index(0.0)]!r}")
    columns = [F.col(c) for c in names]
    shift = np.array(mid)

    def moments(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        gaps = [F.col(c) - F.lit(float(m)) for c, m in zip(names, shift)]  # about the medians, so that no digits cancel
        sums = [F.avg(a) for a in gaps] + [F.avg(gaps[i] * gaps[j]) for i in range(p) for j in range(i, p)]
        found = list(kept.agg(*sums).first())
        mean, cov, at = np.array(found[:p]), np.zeros((p, p)), p
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = found[at] - mean[i] * mean[j]
                at += 1
        return mean + shift, cov

    def nearest(distance: Column, part: float) -> DataFrame:
        marked = rows.withColumn("d", distance)
        limit = marked.agg(F.percentile_approx("d", F.lit(part), F.lit(10_000))).first()[0]  # a sketch: the half need not be exact
        return marked.filter(F.col("d") <= limit)

    centre, cov = moments(nearest(_distance(columns, shift, np.diag(1 / np.square(mad))), share))
    for _ in range(steps):
        nearer = moments(nearest(_distance(columns, centre, np.linalg.inv(cov)), share))
        done = np.linalg.det(nearer[1]) >= np.linalg.det(cov) * (1 - 1e-9)
        centre, cov = nearer
        if done:
            break
    limit = chi2_quantile(OUTLIER_SHARE, p)
    cov = cov * share / chi2_cdf(chi2_quantile(share, p), p + 2)
    kept = rows.withColumn("d", _distance(columns, centre, np.linalg.inv(cov))).filter(F.col("d") <= limit)
    centre, cov = moments(kept)
    cov = cov * OUTLIER_SHARE / chi2_cdf(limit, p + 2)
    distance = _distance(x, centre, np.linalg.inv(cov))
    return df.withColumn("distance", distance).withColumn("is_outlier", F.col("distance") > limit)


# --- trend and season ----------------------------------------------------------------------


def robust_decompose(df: DataFrame, key: Sequence[str], date: str, val: str, period: int, half: int | None = None, rounds: int = 4) -> DataFrame:
    """trend, seasonal, residual and weight of every row (one row per key and day).

    A round fits a weighted line to the deseasoned values within ``half`` days, takes the weighted
    mean of what is left per day of the period, centred, and weights each row by the
    bisquare of its residual over six medians of the absolute residuals, for the next round. Rows
    with a NULL value get a trend and season but no residual, and weigh nothing.
    """
    half = period if half is None else half
    near = W.partitionBy(*key).orderBy("_d").rangeBetween(-half, half)
    phase, whole = W.partitionBy(*key, "_phase"), W.partitionBy(*key)
    own = df.columns
    rows = df.withColumns({"_d": day_number(date).cast("long"), "_y": F.col(val).cast("double")})
    rows = rows.withColumns({"_phase": F.pmod("_d", F.lit(period)), "_t": (F.col("_d") - F.min("_d").over(whole)).cast("double")})
    rows = rows.withColumns({"weight": F.when(F.col("_y").isNotNull(), 1.0).otherwise(0.0), "seasonal": F.lit(0.0)})
    for last in [False] * (rounds - 1) + [True]:
        w, t, z = F.col("weight"), F.col("_t"), F.coalesce(F.col("_y") - F.col("seasonal"), F.lit(0.0))
        sums = {"_a0": w, "_a1": w * t, "_a2": w * t * t, "_b0": w * z, "_b1": w * t * z}
        rows = rows.withColumns({n: F.sum(c).over(near) for n, c in sums.items()})
        a0, a1, a2, b0, b1 = (F.col(n) for n in sums)
        det = a0 * a2 - a1 * a1
        line = (a2 * b0 - a1 * b1 + t * (a0 * b1 - a1 * b0)) / F.when(det > 1e-6, det)
        rows = rows.withColumn("trend", F.coalesce(line, F.try_divide(b0, a0)))
        left = F.coalesce(F.col("_y") - F.col("trend"), F.lit(0.0))
        rows = rows.withColumn("_s", F.coalesce(F.try_divide(F.sum(w * left).over(phase), F.sum(w).over(phase)), F.lit(0.0)))
        rows = rows.withColumn("seasonal", F.col("_s") - F.coalesce(F.try_divide(F.sum(w * F.col("_s")).over(whole), F.sum(w).over(whole)), F.lit(0.0)))
        rows = rows.withColumn("residual", F.col("_y") - F.col("trend") - F.col("seasonal")).drop(*sums, "_s")
        rows = settle(rows, "decomposed")
        # one row per key and day: a series fits into a group
        middle = rows.groupBy(*key).agg(F.median(F.abs("residual")).alias("_m"))
        u = F.coalesce(F.try_divide(F.abs("residual"), BISQUARE_CUT * F.col("_m")), F.when(F.col("residual") == 0, 0.0).otherwise(1.0))
        weight = F.when(u < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        weight = F.when(F.col("residual").isNull(), 0.0).otherwise(weight)
        rows = beside(rows, middle, key).withColumn("weight", weight).drop("_m")
        if last:
            return rows.select(*own, "trend", "seasonal", "residual", "weight")
    raise ValueError("at least one round is needed")
