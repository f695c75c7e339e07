"""Window operators.

Filters on ``row_number`` use Spark's group limit, which trims every group on
the map side. Running and moving operators expect a series at calendar grain
(one row per key and date), so that a group is bounded by the calendar; use
``operators.ordered`` for raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.columns import col_of


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (state tiebreakers there)."""
    return top_n_per_group(df, keys, order, 1)


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None):
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.drop("_rn") if rank is None else out.withColumnRenamed("_rn", rank)


def rank_by(df: DataFrame, by: Sequence[str], order: Sequence[str], kinds: Sequence[str], tiles: int = 4) -> DataFrame:
    """``rank``, ``dense_rank``, ``row_number`` and ``ntile`` per group, for groups of any size.

    Ranks come from counts of distinct order values; ``row_number`` and ``ntile``
    need an ``order`` without ties.
    """
    from tidemark.operators.business import ntile_by_rank
    from tidemark.operators.ordered import running_sums

    out = df
    if {"rank", "dense_rank"} & set(kinds):
        ties = df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1).cast("long"))
        r = running_sums(ties, order, {"_cum": "_n", "dense_rank": "_one"}, by=by)
        keys = [*by, *order]
        side = r.select(*[F.col(k).alias(f"_r_{k}") for k in keys], (F.col("_cum") - F.col("_n") + 1).alias("rank"), "dense_rank")
        side = side.drop(*[k for k in ("rank", "dense_rank") if k not in kinds])
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        out = out.join(side, cond, "left").drop(*[f"_r_{k}" for k in keys])
    if "row_number" in kinds:
        out = running_sums(out.withColumn("_one", F.lit(1).cast("long")), order, {"row_number": "_one"}, by=by).drop("_one")
    if "ntile" in kinds:
        out = ntile_by_rank(out, by, order, tiles, "ntile")
    return out


def _rows(by, order, lo, hi):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(lo, hi)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str | Column, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(col_of(col)).over(_rows(by, order, W.unboundedPreceding, 0)))


def moving_avg(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str | Column, n: int, out: str):
    return df.withColumn(out, F.avg(col_of(col)).over(_rows(by, order, -(n - 1), 0)))


def day_number(date: str | Column) -> Column:
    return F.unix_date(col_of(date).cast("date"))


def days_window(by: Sequence[str], date: str, n: int) -> W:
    """The last ``n`` calendar days including the current one."""
    return W.partitionBy(*by).orderBy(day_number(date)).rangeBetween(-(n - 1), 0)


def moving_days(df: DataFrame, by: Sequence[str], date: str, col: str | Column, spans: Sequence[int], fn="sum"):
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[fn]
    return df.withColumns({f"{fn}_{n}d": agg(col_of(col)).over(days_window(by, date, n)) for n in spans})


def delta(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str, k: int = 1) -> DataFrame:
    """Change against the k-th earlier row and towards the k-th later row."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumns(
        {
            "delta_prev": F.col(col) - F.lag(col, k).over(w),
            "delta_next": F.lead(col, k).over(w) - F.col(col),
        }
    )


def yoy(df: DataFrame, by: Sequence[str], date: str, col: str) -> DataFrame:
    """Same date last year by calendar, not by row count (28 Feb takes 29 Feb when both map to it)."""
    last = df.select(*by, F.col(date).alias("_src"), F.add_months(F.col(date), 12).alias("_d"), F.col(col))
    last = last.groupBy(*by, "_d").agg(F.max_by(col, "_src").alias("prior_year"))
    cond = F.col(date) == F.col("_d")
    right = last.withColumnsRenamed({k: f"_r_{k}" for k in by})
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = df.join(right, cond, "left").drop("_d", *[f"_r_{k}" for k in by])
    return out.withColumn("yoy_pct", F.try_divide(F.col(col) - F.col("prior_year"), F.abs("prior_year")) * 100)


def snapshot_value(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """First and latest known value in the frame up to each row, NULLs ignored."""
    w = _rows(by, order, W.unboundedPreceding, 0)
    return df.withColumns(
        {
            "first_known": F.first(col, ignorenulls=True).over(w),
            "last_known": F.last(col, ignorenulls=True).over(w),
        }
    )


def group_transform(df: DataFrame, by: Sequence[str], col: str | Column, fn: str, out: str) -> DataFrame:
    """Group figure beside each row: aggregate first, join back.

    An unordered window would hold a whole group in one task; the aggregate
    combines on the map side and the join splits hot keys.
    """
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[fn]
    from tidemark.operators.ordered import beside

    return beside(df, df.groupBy(*by).agg(agg(col_of(col)).alias(out)), by)


def rolling_ratio(df: DataFrame, by: Sequence[str], date: str, num: str, den: str, n: int, out: str) -> DataFrame:
    w = days_window(by, date, n)
    return df.withColumn(out, F.try_divide(F.sum(num).over(w).cast("double"), F.sum(den).over(w).cast("double")))


def sequence_gaps(df: DataFrame, by: Sequence[str], seq: str, order: Sequence[str]) -> DataFrame:
    """Rows whose stored sequence number is not their position within the entity.

    Positions are counted range by range, so one entity may hold any share of the rows.
    """
    from tidemark.operators.ordered import running_sums

    numbered = running_sums(df.withColumn("_one", F.lit(1)), order, {"expected_seq": "_one"}, by=by).drop("_one")
    return numbered.filter(~F.col(seq).eqNullSafe(F.col("expected_seq").cast("long")))
