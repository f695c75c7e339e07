"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import all_of, nullify


def stage(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rename, cast and trim: ``{target: (source, type)}``; no joins, no dedup."""
    out = []
    for target, (source, kind) in mapping.items():
        c = F.col(source)
        if kind == "string":
            c = F.trim(c.cast("string"))
        else:
            c = c.try_cast(kind)
        out.append(c.alias(target))
    return df.select(*out)


def star_except(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.drop(*cols)


def star_replace(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    require_columns(df, list(exprs))
    return df.withColumns(dict(exprs))


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_orders(
    df: DataFrame,
    key: str,
    date: str,
    status: str,
    amount: str,
    statuses: Sequence[str],
    order: Sequence[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Typed, valid, non-negative, in range, one row per key (the last in ``order``)."""
    from tidemark.operators.windows import dedup_latest

    require_columns(df, [key, date, status, amount])
    typed = df.withColumns({date: F.col(date).try_cast("date"), amount: F.col(amount).try_cast("double")})
    valid = typed.filter(F.col(date).isNotNull() & F.col(status).isin(*statuses) & (F.col(amount) >= 0))
    ranged = valid.transform(when_set(start, lambda v: F.col(date) >= F.lit(v).cast("date"))).transform(
        when_set(end, lambda v: F.col(date) < F.lit(v).cast("date"))
    )
    return dedup_latest(ranged, [key], [F.desc(c) for c in order])


def when_set(value, predicate: Callable[..., Column]) -> Callable[[DataFrame], DataFrame]:
    """A ``transform`` step that filters only when ``value`` is given."""
    return lambda df: df if value is None else df.filter(predicate(value))


def not_in(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose ``on`` is not among ``keys``; NULLs on either side stay harmless."""
    right = keys.select(F.col(key or on).alias("_key")).filter("_key IS NOT NULL")
    return df.join(right, F.col(on) == F.col("_key"), "left_anti")


def normalize_nulls(df: DataFrame, sentinels: Mapping[str, Sequence], defaults: Mapping | None = None) -> DataFrame:
    """Placeholder values become NULL, then NULL becomes the default where one is given."""
    cols = {c: nullify(c, values) for c, values in sentinels.items()}
    for c, value in (defaults or {}).items():
        cols[c] = F.coalesce(cols.get(c, F.col(c)), F.lit(value))
    return df.withColumns(cols)


def apply_constraints(df: DataFrame, rules: Mapping[str, Column] | Sequence[Column]) -> DataFrame:
    """Global and persona filters: every rule has to hold."""
    return df.filter(all_of(rules))


def map_codes(df: DataFrame, col: str, seed: DataFrame, code: str, label: str, default: str | None = None) -> DataFrame:
    """Lookup-table join instead of a deep CASE."""
    lookup = seed.select(F.col(code).alias("_code"), F.col(label).alias(label))
    out = df.join(lookup, F.col(col) == F.col("_code"), "left").drop("_code")
    return out if default is None else out.withColumn(label, F.coalesce(label, F.lit(default)))


def pipeline(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Linear named steps, one DataFrame each; Catalyst sees a single plan."""
    for step in steps:
        df = df.transform(step)
    return df
