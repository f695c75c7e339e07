"""Distribution drift and time-series anomalies."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.functions.columns import safe_div
from tidemark.functions.distributions import kolmogorov_sf
from tidemark.operators.ordered import beside, column_lookup, exact_quantiles, neighbour, running_sums, unpivot_numeric, value_counts_table
from tidemark.operators.windows import day_number
from tidemark.session import settle

# Stability bands and the floor for empty bins.
PSI_BANDS = {"low": 0.1, "moderate": 0.25}
PSI_FLOOR = 1e-6
MAD_SCALE = 1.4826
MODIFIED_Z_SCALE = 0.6745


def _band(value: Column) -> Column:
    return F.when(value < PSI_BANDS["low"], "low").when(value <= PSI_BANDS["moderate"], "moderate").otherwise("high")


def _psi_terms(e: Column, a: Column) -> Column:
    e = F.when(e == 0, PSI_FLOOR).otherwise(e)
    a = F.when(a == 0, PSI_FLOOR).otherwise(a)
    return (a - e) * F.log(a / e)


def tagged(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Both samples stacked with a side flag; NULLs are left out."""
    one = a.select(F.col(col).cast("double").alias("v"), F.lit(True).alias("is_a"))
    two = b.select(F.col(col).cast("double").alias("v"), F.lit(False).alias("is_a"))
    return one.unionByName(two).filter("v IS NOT NULL")


def psi(expected: DataFrame, actual: DataFrame, col: str, bins: int = 10, strict_reference: bool = False) -> DataFrame:
    """Population stability over quantile bins of ``expected``.

    Outer bins are open, so every actual row counts; ``strict_reference`` instead
    drops values beyond the expected range but still divides by all rows.
    """
    names = {f"c{i}": i / bins for i in range(bins + 1)}
    row = exact_quantiles(expected, col, names).first()  # bins + 1 numbers
    if row is None or row["c0"] is None:
        raise ValueError("the expected sample has no values")
    cuts = sorted({row[c] for c in names})
    both = tagged(expected, actual, col)
    sizes = both.groupBy().agg(F.count(F.when(F.col("is_a"), 1)).alias("ne"), F.count(F.when(~F.col("is_a"), 1)).alias("na"))
    s = sizes.select(F.struct("ne", "na")).scalar()
    if strict_reference:
        both = both.filter(F.col("v").between(cuts[0], cuts[-1]))
    inner = cuts[1:-1]
    number = F.lit(0)
    for c in inner:
        number = number + (F.col("v") >= c).cast("int")
    g = both.groupBy(number.alias("bin")).agg(F.count(F.when(F.col("is_a"), 1)).alias("e"), F.count(F.when(~F.col("is_a"), 1)).alias("a"))
    total = F.sum(_psi_terms(safe_div("e", "_s.ne"), safe_div("a", "_s.na"))).alias("psi")
    out = g.withColumn("_s", s).agg(total, F.count(F.lit(1)).alias("n_bins"))
    return out.withColumn("band", _band(F.col("psi")))


def _category_counts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    one = a.select(F.col(col).cast("string").alias("v"), F.lit(True).alias("is_a"))
    both = one.unionByName(b.select(F.col(col).cast("string").alias("v"), F.lit(False).alias("is_a")))
    return both.groupBy("v").agg(F.count(F.when(F.col("is_a"), 1)).alias("e"), F.count(F.when(~F.col("is_a"), 1)).alias("a"))


def psi_cat(expected: DataFrame, actual: DataFrame, col: str) -> DataFrame:
    g = _category_counts(expected, actual, col)
    s = g.agg(F.struct(F.sum("e").alias("e"), F.sum("a").alias("a"))).scalar()
    out = g.withColumn("_s", s).agg(F.sum(_psi_terms(safe_div("e", "_s.e"), safe_div("a", "_s.a"))).alias("psi"))
    return out.withColumn("band", _band(F.col("psi")))


def _ecdf_pair(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values with both cumulative shares."""
    counts = value_counts_table(tagged(a, b, col), "v", {"na": F.col("is_a"), "nb": ~F.col("is_a")})
    run = running_sums(counts, ["v"], {"ca": "na", "cb": "nb"}, totals={"ta": "na", "tb": "nb"})
    return run.withColumns({"fa": safe_div("ca", "ta"), "fb": safe_div("cb", "tb")})


def ks2(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Largest gap between two empirical distributions, with its asymptotic p value."""
    out = _ecdf_pair(a, b, col).agg(
        F.max(F.abs(F.col("fa") - F.col("fb"))).alias("statistic"), F.max("ta").alias("n_a"), F.max("tb").alias("n_b")
    )
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return out.withColumn("p_value", kolmogorov_sf((en + 0.12 + 0.11 / en) * F.col("statistic")))


def wasserstein(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Area between two empirical distributions."""
    steps = neighbour(_ecdf_pair(a, b, col), [], ["v"], {"_next": "v"}, step=1)
    area = F.abs(F.col("fa") - F.col("fb")) * (F.col("_next") - F.col("v"))
    return steps.agg(F.sum(area).alias("distance"))


def chi2_gof(expected: DataFrame, actual: DataFrame, col: str) -> DataFrame:
    """Chi-square of actual counts against expected shares; unseen categories are reported apart."""
    g = _category_counts(expected, actual, col)
    s = g.agg(F.struct(F.sum("e").alias("e"), F.sum("a").alias("a"))).scalar()
    exp = safe_div(F.col("e") * s["a"], s["e"])
    term = F.when(F.col("e") > 0, safe_div((F.col("a") - exp) * (F.col("a") - exp), exp))
    return g.agg(
        F.sum(term).alias("statistic"), (F.count(F.when(F.col("e") > 0, 1)) - 1).alias("df"),
        F.coalesce(F.sum(F.when(F.col("e") == 0, F.col("a"))), F.lit(0)).alias("n_unseen"),
        F.count(F.when((F.col("e") > 0) & (exp < 5), 1)).alias("n_low_expected"),
    )


PERCENTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def descriptors(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Moments and percentiles per numeric column (and group)."""
    keys = [*by, "column"]
    rows = unpivot_numeric(df, cols, by).filter("value IS NOT NULL")
    base = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    centre = base.select(*keys, F.col("mean").alias("_m"))
    if by:
        joined = rows.join(centre, keys)
    else:
        joined = rows.withColumn("_m", column_lookup(centre, ["_m"])[F.col("column")]["_m"])
    dev = F.col("value") - F.col("_m")
    m2, m3, m4 = (F.avg(F.pow(dev, k)) for k in (2, 3, 4))
    shape = joined.groupBy(*keys).agg(safe_div(m3, F.pow(m2, 1.5)).alias("skewness"), (safe_div(m4, m2 * m2) - 3).alias("kurtosis"))
    return base.join(shape, keys).join(exact_quantiles(rows, "value", PERCENTILES, by=keys), keys)


def category_descriptors(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Distinct count, Shannon entropy (nats) and top-k share per categorical column."""
    from tidemark.operators.profile import column_value_counts

    counts = column_value_counts(df, cols, blank_is_null=False).filter("value IS NOT NULL")
    total = counts.groupBy("column").agg(F.sum("n").alias("_t"))
    share = F.col("n") / F.col("_t")
    j = counts.join(total, "column")
    w = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy("column").agg(F.sum("n").alias("_top"))
    ent = j.groupBy("column", "_t").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum(-share * F.log(share)).alias("entropy"))
    return ent.join(top, "column").select("column", "n_distinct", "entropy", (F.col("_top") / F.col("_t")).alias("top_share"))


def band_check(new: DataFrame, base: DataFrame) -> DataFrame:
    """Is the new median inside the baseline quartiles, and the mean within 5 percent?"""
    b = base.select("column", F.col("p25").alias("base_p25"), F.col("p75").alias("base_p75"), F.col("mean").alias("base_mean"))
    out = new.select("column", "p50", "mean").join(b, "column")
    return out.withColumns(
        {
            "median_in_band": F.col("p50").between(F.col("base_p25"), F.col("base_p75")),
            "mean_within_5pct": F.abs(F.col("mean") - F.col("base_mean")) <= 0.05 * F.abs("base_mean"),
        }
    )


# --- time series (one row per key and day: windows are bounded by the calendar) -----


def seasonal_naive(df: DataFrame, key: Sequence[str], date: str, val: str, lag_days: int) -> DataFrame:
    """Value ``lag_days`` earlier as the forecast, and the residual."""
    side = df.select(*[F.col(k).alias(f"_r_{k}") for k in key], F.date_add(F.col(date), lag_days).alias("_d"), F.col(val).alias("forecast"))
    cond = F.col(date) == F.col("_d")
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = df.join(side, cond, "left").drop("_d", *[f"_r_{k}" for k in key])
    return out.withColumn("residual", F.col(val) - F.col("forecast"))


def anomalies(df: DataFrame, key: Sequence[str], date: str, val: str, method: str = "sigma", days: int = 30, k: float = 3.0):
    """Flag values outside the trailing mean +- k sd, or the key's median +- k scaled MAD."""
    v = F.col(val)
    if method == "sigma":
        w = W.partitionBy(*key).orderBy(day_number(date)).rangeBetween(-days, -1)
        out = df.withColumns({"centre": F.avg(v).over(w), "spread": F.stddev_samp(v).over(w)})
    elif method == "mad":
        mid = settle(exact_quantiles(df, val, {"centre": 0.5}, by=key), "centres")
        dev = beside(df, mid, key).withColumn("_dev", F.abs(v - F.col("centre")))
        mad = exact_quantiles(dev, "_dev", {"_mad": 0.5}, by=key)
        out = beside(dev.drop("_dev"), mad, key).withColumn("spread", MAD_SCALE * F.col("_mad")).drop("_mad")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("is_anomaly", F.coalesce(F.abs(v - F.col("centre")) > k * F.col("spread"), F.lit(False)))


def decompose(df: DataFrame, key: Sequence[str], date: str, val: str, period: int) -> DataFrame:
    """Centred moving average, seasonal mean of the detrended values, residual."""
    half = period // 2
    w = W.partitionBy(*key).orderBy(day_number(date)).rangeBetween(-half, half)
    full = F.count(val).over(w) >= 2 * half + 1
    t = df.withColumn("trend", F.when(full, F.avg(val).over(w)))
    phase = F.pmod(day_number(date), F.lit(period)).alias("_phase")
    t = t.withColumn("_phase", phase)
    seas = t.groupBy(*key, "_phase").agg(F.avg(F.col(val) - F.col("trend")).alias("seasonal"))
    out = t.join(seas, [*key, "_phase"], "left").drop("_phase")
    return out.withColumn("residual", F.col(val) - F.col("trend") - F.col("seasonal"))


def volume_anomaly(counts: DataFrame, date: str, n: str, days: int = 30, k: float = 3.0) -> DataFrame:
    """Daily row counts on a full spine: empty, tenfold or outside mean +- k sd of the days before."""
    spine = counts.agg(F.min(date).alias("a"), F.max(date).alias("b")).select(F.explode(F.sequence("a", "b")).alias(date))
    full = spine.join(counts, date, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    w = W.orderBy(day_number(date)).rangeBetween(-days, -1)  # one row per day
    out = full.withColumns({"mean": F.avg(n).over(w), "sd": F.stddev_samp(n).over(w)})
    flag = (
        F.when(F.col(n) == 0, "empty").when(F.col(n) >= 10 * F.col("mean"), "tenfold")
        .when(F.abs(F.col(n) - F.col("mean")) > k * F.col("sd"), "outside_band")
    )
    return out.withColumn("flag", F.coalesce(flag, F.lit("ok")))


def column_drift(history: DataFrame, run: str, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Latest run's mean and cardinality per column against the band of all earlier runs."""
    runs = unpivot_numeric(history, cols, [run]).groupBy(run, "column").agg(
        F.avg("value").alias("mean"), F.count_distinct(F.col("value")).cast("double").alias("cardinality")
    )
    last = runs.agg(F.max(run)).scalar()
    is_last = F.col(run) == last
    aggs = []
    for m in ("mean", "cardinality"):
        past = F.when(~is_last, F.col(m))
        aggs += [F.max(F.when(is_last, F.col(m))).alias(m), F.avg(past).alias(f"{m}_avg"), F.stddev_samp(past).alias(f"{m}_sd")]
    out = runs.groupBy("column").agg(*aggs)
    return out.withColumns(
        {f"{m}_drift": F.abs(F.col(m) - F.col(f"{m}_avg")) > k * F.col(f"{m}_sd") for m in ("mean", "cardinality")}
    )


def modified_z(df: DataFrame, col: str, t: float = 3.5) -> DataFrame:
    """Rows with a modified z score beyond ``t``."""
    v = F.col(col).cast("double")
    mid = exact_quantiles(df, col, {"m": 0.5}).select("m").scalar()
    dev = df.withColumn("_dev", F.abs(v - mid))
    mad = exact_quantiles(dev, "_dev", {"m": 0.5}).select("m").scalar()
    z = safe_div(MODIFIED_Z_SCALE * (v - mid), mad)
    return df.withColumn("modified_z", z).filter(F.abs("modified_z") > t)


def naive_interval(df: DataFrame, key: Sequence[str], date: str, val: str, lag_days: int) -> DataFrame:
    """Seasonal-naive forecast with the P10-P90 band of residuals seen before that day."""
    r = seasonal_naive(df, key, date, val, lag_days)
    banded = earlier_quantiles(r.withColumn("_day", day_number(date).cast("long")), key, "_day", "residual", {"_lo": 0.1, "_hi": 0.9})
    out = banded.withColumns({"lower": F.col("forecast") + F.col("_lo"), "upper": F.col("forecast") + F.col("_hi")}).drop("_day", "_lo", "_hi")
    return out.withColumn("inside", F.col(val).between(F.col("lower"), F.col("upper")))


class SortedRuns:
    """Numbers in ascending order, kept as short runs: an insertion moves one run only."""

    def __init__(self, run: int = 512):
        self.run, self.runs, self.n = run, [[]], 0

    def add(self, value: float) -> None:
        tops = [own[-1] for own in self.runs[:-1]]
        at = bisect_left(tops, value)
        own = self.runs[at]
        insort(own, value)
        self.n += 1
        if len(own) > 2 * self.run:
            self.runs[at : at + 1] = [own[: self.run], own[self.run :]]

    def __getitem__(self, rank: int) -> float:
        for own in self.runs:
            if rank < len(own):
                return own[rank]
            rank -= len(own)
        raise IndexError(rank)

    def quantile(self, p: float) -> float | None:
        """Linear between the two order statistics around the position."""
        if not self.n:
            return None
        position = (self.n - 1) * p
        lo = self[math.floor(position)]
        hi = self[math.ceil(position)]
        return lo if lo == hi else lo + (hi - lo) * (position - math.floor(position))


def earlier_quantiles(df: DataFrame, key: Sequence[str], order: str, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of all values of the same key with a smaller ``order``, beside each row; NULL values don't count.

    A window would sort what it has seen anew for every row. Here each key's rows pass in
    order through a sorted list: n log n and a little. A key is one series
    (one row per period), which has to fit into a task.
    """
    names = list(probs)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        seen, waiting, last = SortedRuns(), [], None
        columns: list[list] = [[] for _ in names]
        for at, x in zip(table[order].to_pylist(), table[value].cast(pa.float64()).to_pylist()):
            if at != last:
                for v in waiting:
                    seen.add(v)
                waiting, last = [], at
            for column, p in zip(columns, probs.values()):
                column.append(seen.quantile(p) if at is not None else None)
            if x is not None and at is not None:
                waiting.append(x)
        for n, column in zip(names, columns):
            table = table.append_column(n, pa.array(column, pa.float64()))
        return table

    return df.groupBy(*key).applyInArrow(fill, schema)


def interval_coverage(intervals: DataFrame, key: Sequence[str]) -> DataFrame:
    known = intervals.filter(F.col("inside").isNotNull())
    return known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), safe_div(F.count(F.when(F.col("inside"), 1)), F.count(F.lit(1))).alias("coverage")
    )


