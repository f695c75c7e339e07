"""Measures over a star and time intelligence on daily or monthly series.

Series operators expect one row per key and date; their windows are bounded by
the calendar. ``daily_series`` brings raw facts to that grain first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.columns import col_of, money, period, safe_div
from tidemark.operators.dims import periodic_snapshot
from tidemark.operators.windows import days_window


@dataclass(frozen=True)
class Model:
    """A fact, its dimensions ``{name: (df, {role: fact key}, dimension key)}`` and measures."""

    fact: DataFrame
    dims: Mapping[str, tuple[DataFrame, Mapping[str, str], str]]
    measures: Mapping[str, Column] = field(default_factory=dict)


def with_filters(base: Mapping[str, Sequence], new: Mapping[str, Sequence], mode: str = "overwrite") -> dict:
    """Combine ``{column: allowed values}``: overwrite per column, or intersect."""
    out = {k: list(v) for k, v in base.items()}
    for col, values in new.items():
        if mode == "intersect" and col in out:
            out[col] = [v for v in out[col] if v in set(values)]
        else:
            out[col] = list(values)
    return out


def expand(model: Model, used: Sequence[str], roles: Mapping[str, str] | None = None) -> DataFrame:
    """Fact joined to just the dimensions whose columns are used."""
    out = model.fact
    for name, (dim, keys, pk) in model.dims.items():
        wanted = [c for c in dim.columns if c in used and c not in model.fact.columns]
        if not wanted:
            continue
        fk = keys[(roles or {}).get(name, next(iter(keys)))]
        side = dim.select(F.col(pk).alias(f"_pk_{name}"), *wanted)
        out = out.join(side, F.col(fk) == F.col(f"_pk_{name}"), "left").drop(f"_pk_{name}")
    return out


def evaluate(
    model: Model,
    measures: Sequence[str],
    by: Sequence[str] = (),
    filters: Mapping[str, Sequence] | None = None,
    roles: Mapping[str, str] | None = None,
) -> DataFrame:
    """Named measures for any group-by and filter set; joins follow from the model."""
    rows = expand(model, [*by, *(filters or {})], roles)
    for col, values in (filters or {}).items():
        rows = rows.filter(F.col(col).isin(list(values)))
    return rows.groupBy(*by).agg(*[model.measures[m].alias(m) for m in measures])


def filter_by_values(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Keep rows whose value is listed; no relationship needed, nothing multiplied."""
    listed = values.select(F.col(values.columns[0]).alias("_v"))
    return df.join(listed, F.col(col) == F.col("_v"), "left_semi")


def daily_series(df: DataFrame, by: Sequence[str], date: str, val: Column | str) -> DataFrame:
    """One row per key and day, exact sums, combined on the map side."""
    return df.groupBy(*by, F.col(date).cast("date").alias("day")).agg(F.sum(money(val)).alias("v"))


def period_start(date: Column | str, unit: str, fiscal_start: int = 1) -> Column:
    if unit == "year" and fiscal_start != 1:
        shift = fiscal_start - 1
        return F.add_months(period(F.add_months(col_of(date), -shift), "year"), shift)
    return period(date, unit)


def to_date(df: DataFrame, by: Sequence[str], date: str, val: str, unit: str, fiscal_start: int = 1, out: str | None = None):
    """Running total since the start of the month, quarter, year or fiscal year."""
    start = period_start(date, unit, fiscal_start)
    w = W.partitionBy(*by, start).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out or f"{unit}_to_date", F.sum(val).over(w))


SHIFT = {"day": None, "week": None, "month": 1, "quarter": 3, "year": 12}


def _shift(c: Column, n: int, unit: str) -> Column:
    if SHIFT[unit] is None:
        return F.date_add(c, n * (7 if unit == "week" else 1))
    return F.add_months(c, n * SHIFT[unit])


def pct_change(now: Column, before: Column) -> Column:
    return F.try_divide((now - before).cast("double"), F.abs(before).cast("double")) * 100


def _lookup(df: DataFrame, side: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Left join a shifted series (columns by..., _d, ...) on key and date."""
    cond = F.col(date) == F.col("_d")
    right = side.withColumnsRenamed({k: f"_r_{k}" for k in by})
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(right, cond, "left").drop("_d", *[f"_r_{k}" for k in by])


def vs_prior(df: DataFrame, by: Sequence[str], date: str, val: str, unit: str) -> DataFrame:
    """Value one unit earlier and % change; NULL when either side is missing."""
    side = df.groupBy(*by, _shift(F.col(date), 1, unit).alias("_d")).agg(F.max_by(val, date).alias("prior"))
    out = _lookup(df, side, by, date)
    return out.withColumn("change_pct", pct_change(F.col(val), F.col("prior")))


def month_number(c: Column | str) -> Column:
    return F.year(c) * 12 + F.month(c)


def trailing(df: DataFrame, by: Sequence[str], date: str, val: str, n: int, unit: str) -> DataFrame:
    """Sum over the last ``n`` days, or calendar months of a monthly series."""
    w = days_window(by, date, n) if unit == "day" else W.partitionBy(*by).orderBy(month_number(date)).rangeBetween(-(n - 1), 0)
    return df.withColumn(f"trailing_{n}_{unit}", F.sum(val).over(w))


def vs_prior_complete(df: DataFrame, by: Sequence[str], date: str, val: str) -> DataFrame:
    """Year to the last full date against last year cut at the same date."""
    last = df.agg(F.max(date)).scalar()
    start, before = F.trunc(last, "year"), F.add_months(last, -12)
    d = F.col(date)
    now = (d >= start) & (d <= last)
    then = (d >= F.trunc(before, "year")) & (d <= before)
    out = df.groupBy(*by).agg(
        F.sum(F.when(now, F.col(val))).alias("current"), F.sum(F.when(then, F.col(val))).alias("prior")
    )
    return out.withColumn("change_pct", pct_change(F.col("current"), F.col("prior")))


def balances(moves: DataFrame, entity: str, date: str, val: Column | str, unit: str) -> DataFrame:
    """Opening, closing and average daily balance per entity and period."""
    snap = periodic_snapshot(moves, entity, date, val)
    opening = F.min_by(F.col("balance") - F.col("moved"), F.col("day"))
    return snap.groupBy(entity, period("day", unit).alias("period")).agg(
        opening.alias("opening"), F.max_by("balance", "day").alias("closing"), F.avg("balance").alias("average")
    )


def calc_group(df: DataFrame, by: Sequence[str], date: str, measures: Sequence[str]) -> DataFrame:
    """Every measure with its variants (current, YTD, prior year, YoY %) in long form."""
    priors = [F.max_by(m, date).alias(f"{m}|prior_year") for m in measures]
    out = _lookup(df, df.groupBy(*by, F.add_months(F.col(date), 12).alias("_d")).agg(*priors), by, date)
    names = []
    for m in measures:
        out = to_date(out, by, date, m, "year", out=f"{m}|ytd")
        out = out.withColumn(f"{m}|yoy_pct", pct_change(F.col(m), F.col(f"{m}|prior_year")))
        out = out.withColumn(f"{m}|current", F.col(m))
        names += [f"{m}|{v}" for v in ("current", "ytd", "prior_year", "yoy_pct")]
    wide = out.select(*by, date, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    long = wide.unpivot([*by, date], [F.col(f"`{n}`") for n in names], "_name", "value")
    part = F.split("_name", r"\|")
    return long.select(*by, date, part[0].alias("measure"), part[1].alias("variant"), "value")


def pct_of(df: DataFrame, by: Sequence[str], measure: Column | str, where: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Filtered group sums as % of everything, of the kept dimensions and of the filtered total."""
    value = col_of(measure)
    whole = df.agg(F.struct(F.sum(value).alias("all"), F.sum(F.when(where, value)).alias("sel"))).scalar()
    groups = df.filter(where).groupBy(*by).agg(F.sum(value).alias("value"))
    out = groups.withColumns({"pct_of_all": 100 * safe_div("value", whole["all"]), "pct_of_selected": 100 * safe_div("value", whole["sel"])})
    if keep:
        kept = df.groupBy(*keep).agg(F.sum(value).alias("_kept"))
        out = out.join(kept, list(keep)).withColumn("pct_of_kept", 100 * safe_div("value", "_kept")).drop("_kept")
    return out


@dataclass(frozen=True)
class Kpi:
    """A measure with a direction, a target and deviation bands in percent."""

    name: str
    unit: str = ""
    target: float | None = None
    higher_is_better: bool = True
    yellow_pct: float = 5.0
    red_pct: float = 10.0


def kpi_status(df: DataFrame, kpi: Kpi, value: str) -> DataFrame:
    """green / yellow / red by shortfall against the target."""
    sign = 1 if kpi.higher_is_better else -1
    short = 100.0 * sign * (F.lit(kpi.target) - F.col(value)) / abs(kpi.target)
    status = F.when(F.col(value).isNull(), "unknown").when(short >= kpi.red_pct, "red").when(short >= kpi.yellow_pct, "yellow")
    return df.withColumns({"shortfall_pct": short, "status": status.otherwise("green")})


def provisional_thresholds(df: DataFrame, value: str) -> DataFrame:
    from tidemark.operators.ordered import exact_quantiles

    return exact_quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def kpi_strip(monthly: DataFrame, by: Sequence[str], date: str, val: str, as_of: str, n: int = 13) -> DataFrame:
    """Latest value, change to the month before and the last ``n`` points per key."""
    end = F.lit(as_of).cast("date")
    inside = (F.col(date) <= end) & (F.col(date) > F.add_months(end, -n))
    pts = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(val).alias("v"))))  # at most n points
    out = monthly.filter(inside).groupBy(*by).agg(pts.alias("_p"))
    last, prev = F.element_at("_p", -1)["v"], F.try_element_at("_p", F.lit(-2))["v"]
    return out.select(
        *by, last.alias("value"), (last - prev).alias("delta"), F.transform("_p", lambda x: x["v"]).alias("series")
    )


def vs_plan(actual: DataFrame, plan: DataFrame, by: Sequence[str], val: str) -> DataFrame:
    """Actual against plan at the plan's grain: difference and % of plan."""
    a = actual.groupBy(*by).agg(F.sum(val).alias("actual"))
    p = plan.groupBy(*by).agg(F.sum(val).alias("plan"))
    out = a.join(p, list(by), "full")
    diff = F.coalesce("actual", F.lit(0)) - F.coalesce("plan", F.lit(0))
    return out.withColumns({"variance": diff, "variance_pct": F.try_divide(diff.cast("double"), F.abs("plan").cast("double")) * 100})


def ratio_change(df: DataFrame, by: Sequence[str], num: Column | str, den: Column | str, date: str, unit: str) -> DataFrame:
    """Ratio of sums per period, change in percentage points and in relative %."""
    g = df.groupBy(*by, period(date, unit).alias("period")).agg(safe_div(F.sum(col_of(num)), F.sum(col_of(den))).alias("ratio"))
    w = W.partitionBy(*by).orderBy("period")  # one row per period
    prev = F.lag("ratio").over(w)
    return g.withColumns({"change_pp": 100 * (F.col("ratio") - prev), "change_pct": pct_change(F.col("ratio"), prev)})


def seasonal_baseline(monthly: DataFrame, by: Sequence[str], date: str, val: str, years: int = 3) -> DataFrame:
    """Average of the same month over the ``years`` before, and the gap to it."""
    back = F.explode(F.array(*[F.add_months(F.col(date), 12 * k) for k in range(1, years + 1)]))
    side = monthly.select(*by, back.alias("_d"), F.col(val).cast("double").alias("_v"))
    side = side.groupBy(*by, "_d").agg(F.avg("_v").alias("baseline"), F.count("_v").alias("n_years"))
    out = _lookup(monthly, side, by, date)
    return out.withColumn("gap_pct", pct_change(F.col(val), F.col("baseline")))
