"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col_of, safe_div
from tidemark.operators.ordered import exact_quantiles


def cond_agg(df: DataFrame, by: Sequence[str], specs: Mapping[str, tuple[str, Column | str | None, Column]]):
    """``{name: ('sum'|'count'|'avg', value, condition)}`` in a single pass."""
    aggs = []
    for name, (fn, value, cond) in specs.items():
        if fn == "count":
            aggs.append(F.count(F.when(cond, 1)).alias(name))
        else:
            inner = F.when(cond, col_of(value))
            aggs.append((F.sum(inner) if fn == "sum" else F.avg(inner)).alias(name))
    return df.groupBy(*by).agg(*aggs)


def count_semantics(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(col).alias("n_values"),
        F.count_distinct(F.col(col)).alias("n_distinct"),
    )


def approx_distinct(df: DataFrame, by: Sequence[str], col: str, rsd: float = 0.02) -> DataFrame:
    return df.groupBy(*by).agg(F.approx_count_distinct(col, rsd).alias("approx_distinct"))


def distinct_sketch(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """A mergeable sketch per group; roll up with ``merge_sketches``."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(col).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))


def percentiles(df: DataFrame, by: Sequence[str], col: str, ps: Mapping[str, float], approx: bool = False):
    """Exact linear percentiles per group, or one-pass sketches with ``approx``."""
    if approx:
        return df.groupBy(*by).agg(*[F.percentile_approx(col, p, 10000).alias(n) for n, p in ps.items()])
    return exact_quantiles(df, col, ps, by=by)


def subtotals(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column], mode: str = "rollup") -> DataFrame:
    """Rollup, cube or each-dim totals, with the grouping level of every row."""
    level = F.grouping_id().cast("int").alias("level")
    if mode in ("rollup", "cube"):
        return getattr(df, mode)(*dims).agg(level, *aggs)
    if mode == "sets":
        sets = [[F.col(d)] for d in dims] + [[]]
        return df.groupingSets(sets, *[F.col(d) for d in dims]).agg(level, *aggs)
    raise ValueError(f"unknown mode {mode!r}")


def pivot(df: DataFrame, by: Sequence[str], on: str, values: Sequence, agg: Column) -> DataFrame:
    """Stated values only: Spark need not scan for them and the schema stays fixed."""
    return df.groupBy(*by).pivot(on, list(values)).agg(agg)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "metric", value: str = "value"):
    return df.unpivot(list(ids), list(cols), name, value)


def share_of_total(df: DataFrame, by: Sequence[str], measure: str | Column, within: Sequence[str] = ()) -> DataFrame:
    """Group sums with their share of the ``within`` total (or of everything)."""
    groups = df.groupBy(*by).agg(F.sum(col_of(measure)).alias("total"))
    if not within:
        whole = groups.agg(F.sum("total")).scalar()
        return groups.withColumn("share", safe_div(F.col("total"), whole))
    tops = groups.groupBy(*within).agg(F.sum("total").alias("_whole"))
    joined = groups.join(tops, list(within))
    return joined.withColumn("share", safe_div("total", "_whole")).drop("_whole")


def agg_of_agg(df: DataFrame, inner: Sequence[str], outer: Sequence[str], measure: str | Column) -> DataFrame:
    """Average / best / worst of inner-grain sums per outer group."""
    low = df.groupBy(*inner).agg(F.sum(col_of(measure)).cast("double").alias("v"))
    return low.groupBy(*outer).agg(
        F.avg("v").alias("avg_value"), F.max("v").alias("max_value"), F.min("v").alias("min_value")
    )


def ratio(df: DataFrame, num: str | Column, den: str | Column, by: Sequence[str] = (), how: str = "of_sums"):
    """``of_sums`` weights by the denominator; ``mean`` treats each row alike."""
    n, d = col_of(num), col_of(den)
    if how == "of_sums":
        value = safe_div(F.sum(n), F.sum(d))
    elif how == "mean":
        value = F.avg(safe_div(n, d))
    else:
        raise ValueError(f"unknown ratio {how!r}")
    return df.groupBy(*by).agg(value.alias("ratio"))


def concat_agg(df: DataFrame, by: Sequence[str], col: str, sep: str = ",") -> DataFrame:
    """Sorted distinct values as one text; de-duplicated before any list is built.

    The result is one text per group, so it suits columns with few distinct values.
    """
    return (
        df.select(*by, col)
        .distinct()
        .groupBy(*by)
        .agg(F.array_join(F.array_sort(F.collect_list(F.col(col).cast("string"))), sep).alias("values"))
    )


def row_completeness(df: DataFrame, cols: Sequence[str], out: str = "completeness") -> DataFrame:
    filled = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return df.withColumn(out, filled / F.lit(len(cols)))


def build_aggregate(fact: DataFrame, grain: Sequence[str | Column], sums: Mapping[str, Column | str]) -> DataFrame:
    """Coarser fact: exact sums plus the number of atomic rows behind them."""
    return fact.groupBy(*grain).agg(
        *[F.sum(col_of(c)).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("n_rows")
    )
