"""Sorting, limits, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col_of, safe_div


def top_n_others(df: DataFrame, key: str, measure: str | Column, n: int, label: str = "Others") -> DataFrame:
    """Top ``n`` keys and one remainder row; the total stays whole.

    The top keys come from a distributed top-k (each task keeps ``n`` rows).
    """
    totals = df.groupBy(key).agg(F.sum(col_of(measure)).alias("total"))
    top = totals.orderBy(F.desc("total"), F.asc(key)).limit(n).select(F.col(key).alias("_top"))
    tagged = totals.join(top, F.col(key) == F.col("_top"), "left")
    name = F.coalesce(F.col("_top").cast("string"), F.lit(label)).alias(key)
    return tagged.groupBy(name).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n_keys"))


def page_after(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """Keyset page: the filter reaches the scan, nothing is skipped over."""
    rows = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(n)


def value_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Top ``k`` values with share, and one row for the long tail."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    top = counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)
    head = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"))
    tail = head.select(
        F.lit("(other)").alias("value"), (whole["n"] - F.col("n")).alias("n"), (whole["k"] - F.col("k")).alias("n_values")
    )
    rows = top.select("value", "n", F.lit(1).cast("long").alias("n_values"))
    rows = rows.unionByName(tail.filter("n_values > 0"))
    return rows.withColumn("share", safe_div("n", whole["n"]))


def violations(df: DataFrame, rule: Column, order: Sequence[str], n: int = 20) -> DataFrame:
    """First ``n`` rows (in ``order``) that do not satisfy ``rule``; NULL counts as a failure."""
    return df.filter(~F.coalesce(rule, F.lit(False))).orderBy(*order).limit(n)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_distinct(dfs: Sequence[DataFrame]) -> DataFrame:
    return union_all(dfs).distinct()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def diff_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) only in ``a`` or only in ``b``: one grouped count of both.

    One shuffle on the whole row serves both directions.
    """
    cols = a.columns
    both = a.select("*", F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    side = F.when(F.col("_d") > 0, "only_a").otherwise("only_b")
    return net.select(*cols, side.alias("side"), F.abs("_d").alias("copies"))


def insert_new(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target plus the source rows whose key it lacks."""
    known = target.select(*key)
    return target.unionByName(source.join(known, list(key), "left_anti"))
