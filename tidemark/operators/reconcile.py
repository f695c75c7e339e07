"""Reconciliation, row diffs, additivity and idempotency."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import hash_diff, money, safe_div


def _nullsafe_full(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join on NULL-safe keys; the key columns are coalesced."""
    if not keys:
        raise ValueError("need at least one key; use reconcile_total for whole tables")
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    rest = [c for c in [*a.columns, *right.columns] if c not in keys and not c.startswith("_r_")]
    out = a.join(right, cond, "full")
    return out.select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in keys], *rest)


def reconcile_total(a: DataFrame, b: DataFrame, measure_a: Column | str, measure_b: Column | str, tol: float):
    """Control totals of two tables, difference and verdict."""
    ref = b.agg(F.sum(money(measure_b)).alias("s")).scalar()
    s = a.agg(F.sum(money(measure_a)).alias("total_a")).withColumn("total_b", ref)
    diff = F.coalesce("total_a", F.lit(0)) - F.coalesce("total_b", F.lit(0))
    out = s.withColumn("difference", diff).withColumn("passed", F.abs("difference") <= tol)
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_a", "total_b", "difference")})


def reconcile_by(a: DataFrame, b: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per dimension member on both sides with the residual."""

    def side(df, tag):
        return df.groupBy(*dims).agg(*[F.sum(money(m)).alias(f"{m}_{tag}") for m in measures])

    out = _nullsafe_full(side(a, "a"), side(b, "b"), dims)
    cols = list(dims)
    for m in measures:
        residual = F.coalesce(f"{m}_a", F.lit(0)) - F.coalesce(f"{m}_b", F.lit(0))
        cols += [F.col(f"{m}_a").cast("double"), F.col(f"{m}_b").cast("double"), residual.cast("double").alias(f"{m}_residual")]
    return out.select(*cols)


def row_diff(a: DataFrame, b: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Missing, extra and changed rows; ``changed`` names the differing columns."""
    cols = list(cols or [c for c in a.columns if c not in key])
    left = a.select(*key, F.struct(*cols).alias("_a"))
    right = b.select(*key, F.struct(*cols).alias("_b"))
    both = _nullsafe_full(left, right, key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in cols]))
    status = (
        F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing")
        .when(F.size("changed") > 0, "changed").otherwise("same")
    )
    none = F.lit(None).cast("array<string>")
    out = both.withColumn("changed", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), changed).otherwise(none))
    return out.select(*key, status.alias("status"), "changed").filter("status <> 'same'")


def three_level(
    a: DataFrame, b: DataFrame, key: Sequence[str], rules: Mapping[str, Callable[[Column], Column]], measure: str, tol: float
) -> DataFrame:
    """Equality at three levels: raw values, normalised values, business total.

    ``rules`` gives a normalising function per compared column.
    """

    def mismatches(x, y, fix):
        left = x.select(*key, *[(f(F.col(c)) if fix else F.col(c)).alias(c) for c, f in rules.items()])
        right = y.select(*key, *[(f(F.col(c)) if fix else F.col(c)).alias(c) for c, f in rules.items()])
        return row_diff(left, right, key, list(rules)).agg(F.count(F.lit(1)).alias("n_mismatch"))

    def level(df, name):
        return df.select(F.lit(name).alias("level"), F.col("n_mismatch").cast("double").alias("observed"), (F.col("n_mismatch") == 0).alias("passed"))

    total = reconcile_total(a, b, measure, measure, tol).select(
        F.lit("business").alias("level"), F.col("difference").alias("observed"), "passed"
    )
    return level(mismatches(a, b, False), "technical").unionByName(level(mismatches(a, b, True), "semantic")).unionByName(total)


def relative_drift(a: DataFrame, b: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Sum of absolute differences over the sum of absolute reference values."""
    left = a.groupBy(*key).agg(F.sum(money(col)).alias("_a"))
    right = b.groupBy(*key).agg(F.sum(money(col)).alias("_b"))
    both = _nullsafe_full(left, right, key)
    gap = F.sum(F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))))
    return both.agg(safe_div(gap, F.sum(F.abs("_b"))).alias("drift"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row count, sum and xor of row hashes."""
    h = hash_diff(sorted(df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def assert_idempotent(fn: Callable[[], DataFrame]) -> DataFrame:
    """Run twice; raise unless the resulting state is the same. Returns the state."""
    first = table_fingerprint(fn()).first()
    again = fn()
    second = table_fingerprint(again).first()
    if first != second:
        raise ValueError(f"second run changed the result: {first} -> {second}")
    return again


def additivity(atomic: DataFrame, agg: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Groups in which atomic rows do not add up to the aggregate."""
    return reconcile_by(atomic, agg, by, [col]).filter(F.abs(F.col(f"{col}_residual")) > 0.005)


def sample_cells(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Compare ``n`` seeded random keys cell by cell (the sample size is the feature)."""
    draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    picked = a.withColumn("_draw", draw).orderBy("_draw").limit(n).drop("_draw")
    left = picked.select(key, *[F.col(c).cast("string").alias(c) for c in cols])
    left = left.unpivot([key], list(cols), "column", "value_a")
    right = b.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(c) for c in cols])
    right = right.join(picked.select(F.col(key).alias("_p")), F.col("_k") == F.col("_p"), "left_semi")
    right = right.unpivot(["_k"], list(cols), "column", "value_b").withColumnRenamed("column", "_c")
    out = left.join(right, (F.col(key) == F.col("_k")) & (F.col("column") == F.col("_c")), "left").drop("_k", "_c")
    return out.withColumn("is_equal", F.col("value_a").eqNullSafe(F.col("value_b")))


