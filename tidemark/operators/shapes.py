"""Chart-ready shapes: small results from large tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import col_of, micros, safe_div
from tidemark.operators.ordered import average_ranks, beside, exact_quantiles, neighbour, running_sums


def boxplot_stats(df: DataFrame, by: Sequence[str], col: str, k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per group."""
    rows = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).alias("_v"))
    q = exact_quantiles(rows, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})
    v = F.col("_v")
    inside = v.between(F.col("lower"), F.col("upper"))
    return beside(rows, q, by).groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
    )


def ecdf(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Share of rows at or below each value, or at each of ``bins`` equal-width steps."""
    if bins is None:
        r = average_ranks(df, col)
        return r.select(F.col(col).alias("value"), (F.col("cum") / F.col("n_total")).alias("share"))
    v = F.col(col).cast("double")
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    step = (ends["hi"] - ends["lo"]) / bins
    no = F.greatest(F.lit(0), F.ceil(F.coalesce(F.try_divide(v - ends["lo"], step), F.lit(0.0)) - 1e-12))
    g = df.filter(v.isNotNull()).groupBy(no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(g, ["bin"], {"cum": "n"}, totals={"total": "n"})
    return run.select("bin", (ends["lo"] + F.col("bin") * step).alias("value"), (F.col("cum") / F.col("total")).alias("share"))


def bins2d(df: DataFrame, x: str, y: str, n: int = 50) -> DataFrame:
    """Counts on an n x n grid between the exact extremes."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    e = df.agg(F.struct(F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1"))).scalar()

    def cell(v, lo, hi):
        return F.least(F.floor(F.coalesce(F.try_divide(v - lo, (hi - lo) / n), F.lit(0.0))), F.lit(n - 1)).cast("int")

    return df.filter(cx.isNotNull() & cy.isNotNull()).groupBy(
        cell(cx, e["x0"], e["x1"]).alias("bx"), cell(cy, e["y0"], e["y1"]).alias("by")
    ).agg(F.count(F.lit(1)).alias("n"))


def qq_points(df: DataFrame, col: str, n: int = 99) -> DataFrame:
    """Sample quantiles against normal quantiles with the same mean and sd."""
    from tidemark.functions.distributions import normal_quantile

    probs = {f"p{i}": i / (n + 1) for i in range(1, n + 1)}
    v = F.col(col).cast("double")
    m = df.agg(F.struct(F.avg(v).alias("mu"), F.stddev_samp(v).alias("sd"))).scalar()
    wide = exact_quantiles(df, col, probs)
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(k).alias("sample")) for k, p in probs.items()])))
    return rows.withColumn("theoretical", m["mu"] + m["sd"] * normal_quantile(F.col("p")))


def downsample(df: DataFrame, ts: str, val: str, n: int = 1000) -> DataFrame:
    """At most ``n`` time buckets with first time, min, max and mean."""
    t = micros(ts)
    e = df.agg(F.struct(F.min(t).alias("lo"), F.max(t).alias("hi"))).scalar()
    no = F.least(F.floor(safe_div((t - e["lo"]) * n, F.greatest(e["hi"] - e["lo"], F.lit(1)))), F.lit(n - 1))
    return df.groupBy(no.cast("int").alias("bucket")).agg(
        F.min(ts).alias("t0"), F.min(val).alias("lo"), F.max(val).alias("hi"), F.avg(val).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def index_to(df: DataFrame, by: Sequence[str], date: str, val: str, base: str) -> DataFrame:
    """Series with the base period at 100."""
    at = df.filter(F.col(date) == F.lit(base).cast("date")).groupBy(*by).agg(F.sum(val).alias("_b"))
    out = df.join(at, list(by), "left")
    return out.withColumn("indexed", 100 * safe_div(val, "_b")).drop("_b")


def ranks_desc(df: DataFrame, key: str, val, out: str) -> DataFrame:
    """Competition rank by descending total, without a one-task window."""
    g = df.groupBy(key).agg(F.sum(col_of(val)).alias("_v")).withColumn("_neg", -F.col("_v"))
    r = average_ranks(g, "_neg").select(F.col("_neg").alias("_n2"), (F.col("cum") - F.col("n") + 1).alias(out))
    return g.join(r, F.col("_neg") == F.col("_n2")).select(key, F.col("_v").alias(f"{out}_value"), out)


def rank_change(a: DataFrame, b: DataFrame, key: str, val) -> DataFrame:
    """Rank in both periods and the move (positive is up)."""
    both = ranks_desc(a, key, val, "rank_1").join(ranks_desc(b, key, val, "rank_2"), key, "full")
    return both.select(key, "rank_1", "rank_2", (F.col("rank_1") - F.col("rank_2")).alias("move"))


def flow_links(events: DataFrame, key: str, ts: str, stage: str, order: Sequence[str] = ()) -> DataFrame:
    """Transitions between consecutive stages with their count."""
    nxt = neighbour(events.select(key, ts, stage, *order), [key], [ts, *order], {"target": stage}, step=1)
    return nxt.filter(F.col("target").isNotNull()).groupBy(F.col(stage).alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))
