"""Statistics: tests, intervals, effects and regressions on Spark aggregates.

Every test reduces the data to a few numbers per group first; p values are then
Columns over those rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import distributions as ds
from tidemark.functions.columns import col_of, safe_div
from tidemark.session import settle
from tidemark.operators.ordered import (
    average_ranks,
    beside,
    carry_forward,
    column_lookup,
    exact_quantiles,
    running_min,
    running_sums,
    unpivot_numeric,
    value_counts_table,
)
from tidemark.operators.resample import LEAVES, arm_sums, bootstrap_medians, bootstrap_totals, summary

# Fixed value: normal quantile of a two-sided 95 percent interval.
Z95 = 1.959963984540054


def winsorize(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99, out: str = "winsorized") -> DataFrame:
    """Clip to the exact lower and upper quantile."""
    bounds = exact_quantiles(df, col, {"lo": lo, "hi": hi}).select(F.struct("lo", "hi")).scalar()
    clipped = F.least(F.greatest(F.col(col).cast("double"), bounds["lo"]), bounds["hi"])
    return df.withColumn(out, F.when(F.col(col).isNotNull(), clipped))


def _join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys))


# --- descriptives ------------------------------------------------------------------


def describe_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """n, missing share, mean, sd, extremes, quartiles and their range, bias-corrected skewness and kurtosis, outliers."""
    keys = [*by, "column"]
    rows = unpivot_numeric(df, cols, by)
    base = rows.groupBy(*keys).agg(
        F.count("value").alias("n"),
        (100.0 * safe_div(F.count(F.when(F.col("value").isNull(), 1)), F.count(F.lit(1)))).alias("missing_pct"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    base = settle(base, "moments")  # a row for each group: the planner sees that the rows need not be dealt by group to meet it
    known = rows.filter("value IS NOT NULL")
    q = exact_quantiles(known, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=keys)
    side = settle(base.select(*keys, F.col("mean").alias("_m")).join(q, keys), "centres")
    if by:
        marked = known.join(side, keys)
    else:
        marked = known.select("*", column_lookup(side, ["_m", "q1", "q3"])[F.col("column")].alias("_s")).select("column", "value", "_s.*")
    d = F.col("value") - F.col("_m")
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - k * iqr) | (F.col("value") > F.col("q3") + k * iqr)
    shape = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        safe_div(F.avg(d * d * d), F.pow(F.avg(d * d), 1.5)).alias("_g1"),
        (safe_div(F.avg(d * d * d * d), F.pow(F.avg(d * d), 2)) - 3).alias("_g2"),
        F.count(F.when(out, 1)).alias("n_outliers"),
    )
    n = F.col("_n")
    shape = shape.select(
        *keys,
        (F.col("_g1") * safe_div(F.sqrt(n * (n - 1)), n - 2)).alias("skewness"),
        (safe_div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).alias("kurtosis"),
        "n_outliers",
    )
    return _join_keys(_join_keys(base, q.withColumn("iqr", F.col("q3") - F.col("q1")), keys), shape, keys)


def robust_stats(df: DataFrame, col: str, by: Sequence[str] = (), trim: float = 0.1) -> DataFrame:
    """Trimmed mean (values within the trim quantiles), median, MAD and mode (smallest on ties).

    Only the mode needs the counts of all distinct values.
    """
    x = df.select(*by, F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL")
    q = exact_quantiles(x, "_v", {"_lo": trim, "median": 0.5, "_hi": 1 - trim}, by=by)
    near = beside(x, q, by)
    inside = F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))
    mean = near.groupBy(*by).agg(F.avg(inside).alias("trimmed_mean"))
    mad = exact_quantiles(near.select(*by, F.abs(F.col("_v") - F.col("median")).alias("_d")), "_d", {"mad": 0.5}, by=by)
    counts = x.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy(*by).agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("mode"))
    out = q.select(*by, "median")
    for part in (mean, mad, mode):
        out = beside(out, part, by)
    return out


def moments(df: DataFrame, group: Sequence[str], col: str | Column) -> DataFrame:
    v = col_of(col).cast("double")
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def mean_ci(df: DataFrame, by: Sequence[str], col: str, conf: float = 0.95) -> DataFrame:
    """Student t interval of the mean."""
    m = moments(df, by, col)
    half = ds.t_quantile(F.lit(0.5 + conf / 2), F.col("n") - 1) * F.sqrt(safe_div("var", "n"))
    return m.withColumn("_h", half).select(
        *by, "n", "mean", (F.col("mean") - F.col("_h")).alias("ci_low"), (F.col("mean") + F.col("_h")).alias("ci_high")
    )


def bootstrap_ci(df: DataFrame, col: str, stat: str = "mean", n: int = 10_000, conf: float = 0.95, seed: int = 42, leaves: int = LEAVES) -> DataFrame:
    """Percentile interval of a mean, sum or median over bootstrap replicates; see ``operators/resample.py``."""
    if stat in ("mean", "sum"):
        return summary(bootstrap_totals(df, col, stat, n, seed, leaves), conf)
    if stat == "median":
        return summary(bootstrap_medians(df, col, n, seed), conf)
    raise ValueError(f"unknown statistic {stat!r}")


def proportion_ci(df: DataFrame, by: Sequence[str], flag: Column, conf: float = 0.95) -> DataFrame:
    """Clopper-Pearson interval from counts."""
    g = df.groupBy(*by).agg(F.count(F.when(flag, 1)).alias("x"), F.count(F.when(flag.isNotNull(), 1)).alias("n"))
    a = (1 - conf) / 2
    x, n = F.col("x"), F.col("n")
    low = F.when(x == 0, 0.0).otherwise(ds.beta_quantile(F.lit(a), F.greatest(x, F.lit(1)), n - x + 1))
    high = F.when(x == n, 1.0).otherwise(ds.beta_quantile(F.lit(1 - a), x + 1, F.greatest(n - x, F.lit(1))))
    return g.select(*by, "x", "n", safe_div("x", "n").alias("p"), low.alias("ci_low"), high.alias("ci_high"))


# --- two groups -----------------------------------------------------------------------


def two_arm(df: DataFrame, is_b: Column, col: str | Column) -> DataFrame:
    """n, mean, variance of both arms in one row (suffixes _a and _b)."""
    v = col_of(col).cast("double")
    aggs = []
    for tag, cond in (("a", ~is_b), ("b", is_b)):
        x = F.when(cond, v)
        aggs += [F.count(x).alias(f"n_{tag}"), F.avg(x).alias(f"mean_{tag}"), F.var_samp(x).alias(f"var_{tag}")]
    return df.agg(*aggs)


def _welch_df(sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    return safe_div((sa + sb) * (sa + sb), safe_div(sa * sa, na - 1) + safe_div(sb * sb, nb - 1))


def welch(df: DataFrame, is_b: Column, col: str | Column) -> DataFrame:
    """Welch t, degrees of freedom and two-sided p."""
    m = two_arm(df, is_b, col)
    sa, sb = safe_div("var_a", "n_a"), safe_div("var_b", "n_b")
    m = m.withColumns(
        {
            "diff": F.col("mean_b") - F.col("mean_a"),
            "se": F.sqrt(sa + sb),
            "df": _welch_df(sa, sb, F.col("n_a"), F.col("n_b")),
        }
    ).withColumn("t", safe_div("diff", "se"))
    return m.withColumn("p_value", ds.t_two_sided(F.col("t"), F.col("df")))


def one_sample_t(df: DataFrame, col: str | Column, mu: float = 0.0) -> DataFrame:
    m = moments(df, [], col).withColumn("t", safe_div(F.col("mean") - mu, F.sqrt(safe_div("var", "n")))).withColumn("df", F.col("n") - 1)
    return m.withColumn("p_value", ds.t_two_sided(F.col("t"), F.col("df")))


def paired_t(df: DataFrame, before: str, after: str) -> DataFrame:
    return one_sample_t(df, F.col(after) - F.col(before))


def mann_whitney(df: DataFrame, is_b: Column, col: str) -> DataFrame:
    """U of arm b with tie-corrected z, from value counts."""
    counts = value_counts_table(df, col, {"n": F.lit(True), "nb": is_b})
    r = running_sums(counts, [col], {"cum": "n"}, totals={"n_all": "n", "b_all": "nb"})
    rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    s = r.agg(
        F.sum(rank * F.col("nb")).alias("rb"), F.sum(n * n * n - n).alias("ties"), F.max("n_all").cast("double").alias("tot"), F.max("b_all").cast("double").alias("nb")
    )
    nb, na, tot = F.col("nb"), F.col("tot") - F.col("nb"), F.col("tot")
    u = F.col("rb") - nb * (nb + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((tot + 1) - safe_div("ties", tot * (tot - 1))))
    out = s.select(u.alias("u"), safe_div(u - na * nb / 2, sd).alias("z"), na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"))
    return out.withColumn("p_value", ds.two_sided_normal(F.col("z")))


def kruskal(df: DataFrame, group: str, col: str) -> DataFrame:
    """Tie-corrected H over groups."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("c"))
    ranks = average_ranks(counts, col, weight="c").select(F.col(col).alias("_v"), "avg_rank", "n", "n_total")
    j = counts.join(ranks, F.col(col) == F.col("_v"))
    g = j.groupBy(group).agg(F.sum(F.col("avg_rank") * F.col("c")).alias("r"), F.sum("c").alias("ng"))
    n = F.col("n").cast("double")
    t = ranks.agg(F.struct(F.sum(n * n * n - n).alias("ties"), F.max("n_total").cast("double").alias("N"))).scalar()
    h = g.agg(F.sum(F.col("r") * F.col("r") / F.col("ng")).alias("s"), F.count(F.lit(1)).alias("k"))
    tot = t["N"]
    stat = safe_div(12 / (tot * (tot + 1)) * F.col("s") - 3 * (tot + 1), 1 - safe_div(t["ties"], tot * tot * tot - tot))
    out = h.select(stat.alias("h"), (F.col("k") - 1).alias("df"))
    return out.withColumn("p_value", ds.chi2_tail(F.col("h"), F.col("df")))


def wilcoxon(df: DataFrame, before: str, after: str) -> DataFrame:
    """Signed-rank sum of positive differences, tie-corrected z; zero differences are left out."""
    d = df.select((F.col(after) - F.col(before)).alias("_d")).filter("_d <> 0")
    d = d.select(F.abs("_d").alias("_a"), (F.col("_d") > 0).alias("_pos"))
    counts = value_counts_table(d, "_a", {"n": F.lit(True), "np": F.col("_pos")})
    r = running_sums(counts, ["_a"], {"cum": "n"}, totals={"n_all": "n"})
    rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    s = r.agg(F.sum(rank * F.col("np")).alias("w"), F.sum(n * n * n - n).alias("ties"), F.max("n_all").cast("double").alias("n"))
    m = F.col("n")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    out = s.select("w", safe_div(F.col("w") - m * (m + 1) / 4, sd).alias("z"), m.cast("long").alias("n"))
    return out.withColumn("p_value", ds.two_sided_normal(F.col("z")))


def two_proportion_z(df: DataFrame, is_b: Column, flag: Column) -> DataFrame:
    m = df.agg(
        F.count(F.when(~is_b, 1)).alias("n_a"), F.count(F.when(~is_b & flag, 1)).alias("x_a"),
        F.count(F.when(is_b, 1)).alias("n_b"), F.count(F.when(is_b & flag, 1)).alias("x_b"),
    )
    pa, pb = safe_div("x_a", "n_a"), safe_div("x_b", "n_b")
    pool = safe_div(F.col("x_a") + F.col("x_b"), F.col("n_a") + F.col("n_b"))
    z = safe_div(pb - pa, F.sqrt(pool * (1 - pool) * (safe_div(F.lit(1), "n_a") + safe_div(F.lit(1), "n_b"))))
    out = m.withColumns({"p_a": pa, "p_b": pb, "z": z})
    return out.withColumn("p_value", ds.two_sided_normal(F.col("z")))


# --- more groups -----------------------------------------------------------------------


def _anova_sums(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F and eta squared from group rows (n, mean, var)."""
    w = g.groupBy(*by).agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"),
    )
    w = w.withColumn("grand", safe_div("s", "N"))
    side = w.select(*by, "grand")
    j = g.join(side, list(by)) if by else g.withColumn("grand", side.scalar())
    dev = F.col("mean") - F.col("grand")
    ssb = j.groupBy(*by).agg(F.sum(F.col("n") * dev * dev).alias("ssb"))
    out = w.join(ssb, list(by)) if by else w.withColumn("ssb", ssb.scalar())
    dfb, dfw = F.col("k") - 1, F.col("N") - F.col("k")
    return out.select(
        *by, safe_div(safe_div("ssb", dfb), safe_div("ssw", dfw)).alias("f"), dfb.alias("df_between"), dfw.alias("df_within"),
        safe_div("ssb", F.col("ssb") + F.col("ssw")).alias("eta_squared"),
    )


def anova(df: DataFrame, group: str, col: str) -> DataFrame:
    out = _anova_sums(moments(df.filter(F.col(col).isNotNull()), [group], col))
    return out.withColumn("p_value", ds.f_tail(F.col("f"), F.col("df_between"), F.col("df_within")))


def variance_explained(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Eta squared of each factor alone, all factors in one pass."""
    wide = df.filter(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), *[F.col(f).cast("string") for f in factors])
    long = wide.unpivot(["_y"], list(factors), "factor", "level")
    return _anova_sums(moments(long, ["factor", "level"], "_y"), ["factor"])


def pairwise(df: DataFrame, group: str, col: str, method: str = "bh") -> DataFrame:
    """Welch tests for every pair of groups (group rows only), corrected p."""
    # number the groups, let each unfold the numbers after its own, match by number
    m = moments(df.filter(F.col(group).isNotNull()), [group], col).withColumn("_one", F.lit(1).cast("long"))
    m = settle(running_sums(m, [group], {"_i": "_one"}, totals={"_g": "_one"}), "groups")
    a = m.filter(F.col("_i") < F.col("_g")).select(
        F.col(group).alias("group_a"), F.col("n").alias("na"), F.col("mean").alias("ma"), F.col("var").alias("va"),
        F.explode(F.sequence(F.col("_i") + 1, F.col("_g"))).alias("_j"),
    )
    b = m.select(F.col("_i").alias("_j"), F.col(group).alias("group_b"), F.col("n").alias("nb"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    j = a.join(b, "_j")
    sa, sb = safe_div("va", "na"), safe_div("vb", "nb")
    j = j.select(
        "group_a", "group_b", (F.col("mb") - F.col("ma")).alias("diff"), safe_div(F.col("mb") - F.col("ma"), F.sqrt(sa + sb)).alias("t"),
        _welch_df(sa, sb, F.col("na"), F.col("nb")).alias("df"),
    )
    return adjust_p(j.withColumn("p_value", ds.t_two_sided(F.col("t"), F.col("df"))), "p_value", method)


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories: statistic, df, p, smallest expected count, Cramer's V."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    tot = cells.agg(F.sum("o").cast("double").alias("n")).scalar()
    # sum over all cells of (o-e)^2/e = sum over occupied cells of o^2/e - n
    j = cells.join(ra, a).join(cb, b).withColumn("e", F.col("ra") * F.col("cb") / tot)
    s = j.agg(F.sum(F.col("o") * F.col("o") / F.col("e")).alias("q"), F.sum("o").cast("double").alias("n"))
    shape = F.struct(F.count(F.lit(1)).alias("k"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows, cols = ra.withColumnRenamed("ra", "t").agg(shape).scalar(), cb.withColumnRenamed("cb", "t").agg(shape).scalar()
    s = s.withColumns({"_r": rows, "_c": cols})
    stat = F.col("q") - F.col("n")
    small = F.least(F.col("_r.k"), F.col("_c.k")) - 1
    out = s.select(
        stat.alias("statistic"), ((F.col("_r.k") - 1) * (F.col("_c.k") - 1)).alias("df"),
        safe_div(F.col("_r.lo") * F.col("_c.lo"), "n").alias("min_expected"),
        F.sqrt(safe_div(stat, F.col("n") * small)).alias("cramers_v"),
    )
    out = out.withColumn("p_value", ds.chi2_tail(F.col("statistic"), F.col("df")))
    return out.withColumn("low_expected", F.col("min_expected") < 5)


def fisher_exact(table: DataFrame) -> DataFrame:
    """Two-sided Fisher p of 2 x 2 count rows (columns a, b, c, d), for margins of any size.

    Probabilities are taken relative to one term and followed outwards by the ratio of
    neighbours until they no longer count: about the square root of the counts.
    """
    def p_values(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(a, b, c, d):
            r1, r2, c1 = a + b, c + d, a + c
            lo, hi = max(0, c1 - r2), min(r1, c1)

            def log_steps(k, way, n):
                """Log ratios of the ``n`` terms beyond k to the terms before them."""
                at = k + np.arange(n, dtype="float64") * way
                up, down = (at, at + 1) if way > 0 else (at - 1, at)
                ratio = np.log(r1 - up) + np.log(c1 - up) - np.log(down) - np.log(r2 - c1 + down)
                return ratio * way

            def outward(k, way):
                """Sum of the terms from k on, in units of the term at k."""
                total, log_term, room = 1.0, 0.0, hi - k if way > 0 else k - lo
                while room > 0:
                    n = min(room, 4096)
                    logs = log_term + np.cumsum(log_steps(k, way, n))
                    total += float(np.exp(logs).sum())
                    k, room, log_term = k + n * way, room - n, float(logs[-1])
                    if np.exp(log_term) < 1e-18 * total:
                        break
                return total

            mode = min(hi, max(lo, int((r1 + 1) * (c1 + 1) / (r1 + r2 + 2))))
            whole = outward(mode, 1) + outward(mode, -1) - 1.0
            if a == mode:
                return 1.0
            way, seen, k = (1 if a > mode else -1), 0.0, mode
            while k != a:  # log of the observed term in units of the one at the mode
                n = min(abs(a - k), 1 << 20)
                seen += float(log_steps(k, way, n).sum())
                k += n * way
            total, log_term, k = outward(a, way), 0.0, mode
            end = lo if way > 0 else hi
            while k != end:  # on the other side, from the first term that is no likelier than the observed one
                n = min(abs(end - k), 4096)
                logs = log_term + np.cumsum(log_steps(k, -way, n))
                rare = np.flatnonzero(logs <= seen + 1e-7)
                if len(rare):
                    at = k - way * (int(rare[0]) + 1)
                    total += np.exp(float(logs[rare[0]]) - seen) * outward(at, -way)
                    break
                k, log_term = k - n * way, float(logs[-1])
            return float(min(1.0, np.exp(seen) * total / whole))

        return pd.Series([one(*map(int, r)) for r in zip(a, b, c, d, strict=True)], dtype="float64")

    return table.withColumn("p_value", F.pandas_udf(p_values, "double")("a", "b", "c", "d"))


def adjust_p(df: DataFrame, p: str, method: str = "bh") -> DataFrame:
    """Bonferroni or Benjamini-Hochberg adjusted p; ranks and minima run over value ranges."""
    if method == "bonferroni":
        m = df.agg(F.count(p)).scalar()
        return df.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m))
    if method != "bh":
        raise ValueError(f"unknown method {method!r}")
    r = average_ranks(df, p).withColumn("_q", F.col(p) * F.col("n_total") / F.col("cum"))
    r = running_min(r.withColumn("_down", -F.col(p)), ["_down"], "_q", "_adj")
    side = r.select(F.col(p).alias("_p"), F.least(F.lit(1.0), "_adj").alias("p_adjusted"))
    return df.join(side, F.col(p) == F.col("_p"), "left").drop("_p")


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlations of every column pair in long form."""
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1 :]]
    if method == "pearson":
        out = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.corr(x, y).alias("r")) for x, y in pairs]
        return df.agg(F.array(*out).alias("c")).select(F.inline("c"))
    if method != "spearman":
        raise ValueError(f"unknown method {method!r}")
    parts = [spearman(df, x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "r") for x, y in pairs]
    return reduce(DataFrame.unionByName, parts)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation from joint value counts (hot values are combined first)."""
    joint = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("c"))
    rx = average_ranks(joint, "_x", weight="c").select(F.col("_x").alias("vx"), F.col("avg_rank").alias("rx"))
    ry = average_ranks(joint, "_y", weight="c").select(F.col("_y").alias("vy"), F.col("avg_rank").alias("ry"))
    j = joint.join(rx, F.col("_x") == F.col("vx")).join(ry, F.col("_y") == F.col("vy"))
    mid = (joint.agg(F.sum("c").cast("double")).scalar() + 1) / 2  # mean of all ranks
    a, b, c = F.col("rx") - mid, F.col("ry") - mid, F.col("c")
    return j.agg(safe_div(F.sum(c * a * b), F.sqrt(F.sum(c * a * a) * F.sum(c * b * b))).alias("r"))


# --- regression ---------------------------------------------------------------------------


def _design(df: DataFrame, xs: Sequence[str], dummies: Mapping[str, Sequence[str]] | None) -> tuple[list[str], list[Column]]:
    names, cols = ["intercept"], [F.lit(1.0)]
    for x in xs:
        names.append(x)
        cols.append(F.col(x).cast("double"))
    for c, levels in (dummies or {}).items():
        for level in list(levels)[1:]:  # the first level is the reference
            names.append(f"{c}[{level}]")
            cols.append((F.col(c) == level).cast("double"))
    return names, cols


def _cross_products(df: DataFrame, cols: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """X'WX in one aggregate; a k x k matrix on the driver."""
    w = F.lit(1.0) if weight is None else weight
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"s{i}_{j}"]
    return out


def ols(
    df: DataFrame, y: str, xs: Sequence[str], dummies: Mapping[str, Sequence[str]] | None = None, robust: bool = False
) -> DataFrame:
    """Least squares with standard errors, p values, R2 and VIF; HC3 errors on request.

    Two or three passes that each leave a k x k matrix; no row ever leaves Spark.
    Columns are centred first, so large values do not spoil the normal equations.
    """
    spark = df.sparkSession
    names, design = _design(df, xs, dummies)
    known = df
    for c in [y, *xs, *(dummies or {})]:
        known = known.filter(F.col(c).isNotNull())
    raw = known.select(F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(design)])
    k = len(names)
    means = raw.agg(*[F.avg(f"_x{i}").alias(f"m{i}") for i in range(1, k)], F.avg("_y").alias("my"), F.count(F.lit(1)).alias("n")).first()
    n, centre = means["n"], np.array([0.0] + [means[f"m{i}"] for i in range(1, k)])
    xc = [F.lit(1.0)] + [F.col(f"_x{i}") - F.lit(float(centre[i])) for i in range(1, k)]
    full = _cross_products(raw, [*xc, F.col("_y") - F.lit(means["my"])])
    gram, xy, yy = full[:k, :k], full[:k, k], full[k, k]
    inv = np.linalg.inv(gram)
    beta = inv @ xy
    rss = float(yy - beta @ xy)
    sigma2 = rss / (n - k)
    cov = inv * sigma2
    if robust:
        fitted = F.lit(means["my"]) + sum((F.lit(float(b)) * c for b, c in zip(beta, xc, strict=True)), F.lit(0.0))
        lev = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                lev = lev + F.lit(float(inv[i, j])) * xc[i] * xc[j]
        e = (F.col("_y") - fitted) / (1 - lev)
        cov = inv @ _cross_products(raw, xc, e * e) @ inv
    # back from centred to original columns
    shift = np.eye(k)
    shift[0, 1:] = -centre[1:]
    coef = shift @ beta
    coef[0] += means["my"]
    cov = shift @ cov @ shift.T
    slopes = gram[1:, 1:]
    corr = slopes / np.sqrt(np.outer(np.diag(slopes), np.diag(slopes))) if k > 1 else np.ones((0, 0))
    vif = [None, *(float(v) for v in np.diag(np.linalg.inv(corr)))] if k > 1 else [None]
    rows = [
        (names[i], float(coef[i]), float(np.sqrt(cov[i, i])), vif[i], int(n), float(1 - rss / yy), int(n - k)) for i in range(k)
    ]
    out = spark.createDataFrame(rows, "term string, estimate double, std_error double, vif double, n long, r_squared double, df long")
    out = out.withColumn("t", safe_div("estimate", "std_error"))
    return out.withColumn("p_value", ds.t_two_sided(F.col("t"), F.col("df")))


def glm(df: DataFrame, y: str, xs: Sequence[str], family: str = "binomial") -> DataFrame:
    """Logistic (binomial) or Poisson regression: estimates, errors and p values.

    The fit uses rows whose values are all known; ``features.left_out`` counts the others.
    """
    known = df.withColumn("_y", F.col(y).cast("double")).na.drop(subset=["_y", *xs])
    data = VectorAssembler(inputCols=list(xs), outputCol="_f").transform(known)
    fit = GeneralizedLinearRegression(featuresCol="_f", labelCol="_y", family=family, maxIter=50).fit(data)
    s = fit.summary
    names = [*xs, "intercept"]
    values = [*fit.coefficients.toArray(), fit.intercept]
    rows = [
        (n, float(v), float(e), float(t), float(p))
        for n, v, e, t, p in zip(names, values, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z double, p_value double")


# --- effects and experiments ----------------------------------------------------------------


def effect_size(df: DataFrame, is_b: Column, col: str) -> DataFrame:
    """Absolute and relative difference, Cohen's d."""
    m = two_arm(df, is_b, col)
    squares = (F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")
    pooled = F.sqrt(safe_div(squares, F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("mean_b") - F.col("mean_a")
    return m.select(diff.alias("absolute"), safe_div(diff, "mean_a").alias("relative"), safe_div(diff, pooled).alias("cohens_d"))


def ab_test(df: DataFrame, is_b: Column, col: str, mde: float, alpha: float = 0.05) -> DataFrame:
    """Difference, 95 % interval, p and the act / do-not-act cell."""
    w = welch(df, is_b, col)
    half = ds.t_quantile(F.lit(1 - alpha / 2), F.col("df")) * F.col("se")
    w = w.withColumn("_h", half)
    sig, big = F.col("p_value") < alpha, F.abs("diff") >= mde
    cell = (
        F.when(sig & big, "act").when(sig, "do_not_act_trivial").when(big, "do_not_act_underpowered").otherwise("do_not_act_no_evidence")
    )
    return w.select(
        "n_a", "n_b", "mean_a", "mean_b", "diff", (F.col("diff") - F.col("_h")).alias("ci_low"),
        (F.col("diff") + F.col("_h")).alias("ci_high"), "t", "df", "p_value", cell.alias("decision"),
    )


def required_n(df: DataFrame, by: Sequence[str], col: str, mde: float) -> DataFrame:
    """Rows per arm for the effect (16 var / mde^2) and the effect detectable with the rows at hand."""
    m = moments(df, by, col)
    need = F.ceil(16 * F.col("var") / (mde * mde))
    return m.select(
        *by, "n", need.alias("required_n"), F.sqrt(safe_div(32 * F.col("var"), "n")).alias("detectable_effect"),
        (F.col("n") >= 2 * need).alias("is_powered"),
    )


def simpson(df: DataFrame, treated: Column, y: Column | str, strata: Sequence[str]) -> DataFrame:
    """Aggregate effect, stratum-weighted effect and whether the signs disagree."""
    v = col_of(y).cast("double")
    g = df.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(treated, v)) - F.avg(F.when(~treated, v))).alias("effect"),
    )
    whole = df.agg((F.avg(F.when(treated, v)) - F.avg(F.when(~treated, v)))).scalar()
    s = g.filter("effect IS NOT NULL").agg(
        safe_div(F.sum(F.col("effect") * F.col("n")), F.sum("n")).alias("adjusted_effect"),
        F.count(F.lit(1)).alias("n_strata"),
        F.count(F.when(F.col("effect") > 0, 1)).alias("n_positive"),
        F.count(F.when(F.col("effect") < 0, 1)).alias("n_negative"),
    )
    s = s.withColumn("aggregate_effect", whole)
    flips = F.signum("aggregate_effect") * F.signum("adjusted_effect") < 0
    every = ((F.col("n_positive") == F.col("n_strata")) & (F.col("aggregate_effect") < 0)) | (
        (F.col("n_negative") == F.col("n_strata")) & (F.col("aggregate_effect") > 0)
    )
    return s.withColumns({"sign_flips": flips, "is_simpson": every})


def psm_att(df: DataFrame, key: str, treated: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Average effect on the treated by nearest propensity score, with replacement.

    Neighbours come from carrying the last and the next control along the score
    order in value ranges: linear, no pairing of treated with all controls. Rows with an
    unknown value can't be scored; ``features.left_out`` counts them.
    """
    known = df.withColumn("_t", F.col(treated).cast("double")).na.drop(subset=["_t", y, *xs])
    data = VectorAssembler(inputCols=list(xs), outputCol="_f").transform(known)
    fit = LogisticRegression(featuresCol="_f", labelCol="_t", maxIter=50).fit(data)
    # score from the coefficients, in plain columns
    line = F.lit(float(fit.intercept))
    for b, x in zip(fit.coefficients.toArray(), xs, strict=True):
        line = line + F.lit(float(b)) * F.col(x).cast("double")
    scored = data.select(key, F.col("_t"), F.col(y).cast("double").alias("_y"), (1 / (1 + F.exp(-line))).alias("s"))
    scored = settle(scored, "propensity").withColumns({"_c": F.when(F.col("_t") == 0, F.struct("s", "_y")), "_neg": -F.col("s")})
    below = carry_forward(scored, [], ["s", key], {"_lo": "_c"})
    both = carry_forward(below, [], ["_neg", key], {"_hi": "_c"}).filter("_t = 1")
    dl, dh = F.col("s") - F.col("_lo.s"), F.col("_hi.s") - F.col("s")
    match = F.when(F.col("_hi").isNull() | (dl <= dh), F.col("_lo")).otherwise(F.col("_hi"))
    pairs = both.withColumn("_m", match)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_treated"), F.avg(F.col("_y") - F.col("_m._y")).alias("att"),
        F.avg(F.abs(F.col("s") - F.col("_m.s"))).alias("mean_score_gap"),
    )


def did(df: DataFrame, treated: Column, post: Column, y: str) -> DataFrame:
    """Difference-in-differences of four cell means with its standard error."""
    v = F.col(y).cast("double")
    aggs = []
    for t, ct in ((1, treated), (0, ~treated)):
        for p, cp in ((1, post), (0, ~post)):
            x = F.when(ct & cp, v)
            aggs += [F.avg(x).alias(f"m{t}{p}"), safe_div(F.var_samp(x), F.count(x)).alias(f"v{t}{p}")]
    m = df.agg(*aggs)
    est = F.col("m11") - F.col("m10") - (F.col("m01") - F.col("m00"))
    se = F.sqrt(F.col("v11") + F.col("v10") + F.col("v01") + F.col("v00"))
    return m.select("m11", "m10", "m01", "m00", est.alias("effect"), se.alias("se"))


def permutation_test(df: DataFrame, is_b: Column, y: str, n: int = 10_000, seed: int = 42, exact: bool = True, leaves: int = LEAVES) -> DataFrame:
    """Share of relabelled samples whose mean difference is at least as large.

    ``exact`` keeps the arm sizes; otherwise each row draws its arm with the observed
    share. Neither unfolds the rows: see ``operators/resample.py``. Rows without an arm or a value are left out.
    """
    base = df.select(F.col(y).cast("double").alias("_v"), is_b.alias("_b")).filter("_v IS NOT NULL AND _b IS NOT NULL")
    one = lambda arm: F.when(arm, F.col("_v"))
    obs = base.agg(
        (F.avg(one(F.col("_b"))) - F.avg(one(~F.col("_b")))).alias("d"), F.count(one(F.col("_b"))).alias("nb"), F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total")
    ).first()  # four numbers
    if obs["d"] is None:
        raise ValueError("both arms need values")
    arms = arm_sums(base, "_v", obs["nb"], n, seed, exact, leaves)
    size, total = F.col("size"), F.col("total")
    d = arms.select((F.try_divide(total, size) - F.try_divide(F.lit(obs["total"]) - total, F.lit(float(obs["n"])) - size)).alias("d"))
    hit = F.count(F.when(F.abs("d") >= abs(obs["d"]), 1))
    return d.agg(F.lit(obs["d"]).alias("observed"), F.count(F.lit(1)).alias("n_permutations"), ((hit + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def leave_one_out(df: DataFrame, group: str, col: str) -> DataFrame:
    """Mean without each group (totals minus group) and its shift from the full mean."""
    g = df.groupBy(group).agg(F.sum(F.col(col).cast("double")).alias("s"), F.count(col).alias("n"))
    t = g.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n"))).scalar()
    full = safe_div(t["s"], t["n"])
    rest = safe_div(t["s"] - F.col("s"), t["n"] - F.col("n"))
    return g.select(group, rest.alias("mean_without"), (rest - full).alias("shift"))


def outlier_sensitivity(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Mean before and after winsorising."""
    w = winsorize(df, col, lo, hi)
    out = w.agg(F.avg(F.col(col).cast("double")).alias("mean"), F.avg("winsorized").alias("winsorized_mean"))
    return out.withColumn("change_pct", 100 * safe_div(F.col("winsorized_mean") - F.col("mean"), F.abs("mean")))


def missingness(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Outcome mean with and without a value, per column."""
    v = F.col(y).cast("double")
    out = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
            F.avg(F.when(F.col(c).isNull(), v)).alias("mean_missing"), F.avg(F.when(F.col(c).isNotNull(), v)).alias("mean_present"),
        )
        for c in cols
    ]
    rows = df.agg(F.array(*out).alias("r")).select(F.inline("r"))
    return rows.withColumn("difference", F.col("mean_missing") - F.col("mean_present"))


def autocorr(df: DataFrame, key: Sequence[str], date: str, val: str, k: int = 1) -> DataFrame:
    """Lag-k correlation and Durbin-Watson of deviations from the mean, per key.

    Expects one row per key and date, so the window is bounded by the calendar.
    """
    mean = df.groupBy(*key).agg(F.avg(val).alias("_m"))
    d = df.join(mean, list(key)).withColumn("_e", F.col(val) - F.col("_m"))
    w = W.partitionBy(*key).orderBy(date)
    x = d.withColumns({"_l": F.lag(val, k).over(w), "_e1": F.lag("_e", 1).over(w)})
    step = F.col("_e") - F.col("_e1")
    return x.groupBy(*key).agg(F.corr(val, "_l").alias("autocorrelation"), safe_div(F.sum(step * step), F.sum(F.col("_e") * F.col("_e"))).alias("durbin_watson"))


def e_value(rr: Column) -> Column:
    """Confounding strength that could explain a risk ratio away."""
    r = F.when(rr < 1, safe_div(F.lit(1), rr)).otherwise(rr)
    return r + F.sqrt(r * (r - 1))


def risk_ratio(df: DataFrame, exposed: Column, event: Column, by: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*by).agg(
        safe_div(F.count(F.when(exposed & event, 1)), F.count(F.when(exposed, 1))).alias("risk_exposed"),
        safe_div(F.count(F.when(~exposed & event, 1)), F.count(F.when(~exposed, 1))).alias("risk_other"),
    )
    g = g.withColumn("risk_ratio", safe_div("risk_exposed", "risk_other"))
    return g.withColumn("e_value", e_value(F.col("risk_ratio")))
