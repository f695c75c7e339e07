"""Run ledger, pipeline health, freshness, alerts, lineage and user-defined functions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import micros, safe_div
from tidemark.operators.loads import append_ledger
from tidemark.operators.ordered import exact_quantiles, neighbour
from tidemark.operators.privacy import reachable

RUN_SCHEMA = "model string, started_at timestamp_ntz, ended_at timestamp_ntz, status string, n_rows long, error string"


def record_run(
    spark: SparkSession, ledger: str, model: str, build: Callable[[], DataFrame], path: str, clock: Callable[[], dt.datetime]
) -> DataFrame:
    """Build and write a table; append one ledger row with status and row count (from the file footers)."""
    started = clock()
    try:
        build().write.mode("errorifexists").parquet(path)
        n = spark.read.parquet(path).count()
        append_ledger(spark, ledger, [(model, started, clock(), "success", n, None)], RUN_SCHEMA)
    except Exception as err:
        append_ledger(spark, ledger, [(model, started, clock(), "failed", None, str(err))], RUN_SCHEMA)
        raise
    return spark.read.parquet(path)


def pipeline_health(runs: DataFrame, model: str, status: str, duration: str) -> DataFrame:
    """Runs, failures, median, P95 and slowest duration per model."""
    g = runs.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count(F.when(F.col(status) == "failed", 1)).alias("n_failed"), F.max(duration).alias("slowest")
    )
    q = exact_quantiles(runs, duration, {"p50": 0.5, "p95": 0.95}, by=[model])
    return g.join(q, model).withColumn("failed_pct", 100 * safe_div("n_failed", "n_runs"))


def failure_pareto(runs: DataFrame, model: str, status: str) -> DataFrame:
    from tidemark.operators.business import pareto

    failed = runs.filter(F.col(status) == "failed").withColumn("_one", F.lit(1).cast("long"))
    return pareto(failed, model, "_one")


def freshness_checks(tables: Mapping[str, tuple[DataFrame, str]], as_of: str, warn_hours: float, error_hours: float) -> DataFrame:
    """Age of the newest row per table and its band."""
    parts = []
    now = F.lit(as_of).cast("timestamp_ntz")
    for name, (df, ts) in tables.items():
        age = (micros(now) - micros(F.max(ts))) / F.lit(3.6e9)
        parts.append(df.agg(F.lit(name).alias("table"), F.max(ts).cast("timestamp_ntz").alias("newest"), age.alias("age_hours")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    status = F.when(F.col("age_hours") > error_hours, "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return out.withColumn("status", status)


def alerts(results: DataFrame, rule: Sequence[str], ts: str, passed: str = "passed", hours: float = 24) -> DataFrame:
    """Failures as alerts; a repeat within ``hours`` of the previous one is suppressed."""
    failed = results.filter(~F.col(passed)).select(*rule, ts).distinct()
    prev = neighbour(failed, rule, [ts], {"previous_at": ts}, step=-1)
    gap = (micros(ts) - micros("previous_at")) / F.lit(3.6e9)
    return prev.withColumn("is_suppressed", F.coalesce(gap <= hours, F.lit(False)))


def downstream(edges: DataFrame, tables: DataFrame, source: str, target: str) -> DataFrame:
    """Everything that depends on the given tables, with the distance."""
    return reachable(edges, tables, source, target).filter("depth > 0")


# --- reusable and user-defined functions -----------------------------------------------


def net_price(price: Column, discount: Column) -> Column:
    """A macro is a plain function from Columns to a Column."""
    return price * (1 - discount)


def register_net_price(spark: SparkSession, name: str = "net_price") -> None:
    """The same rule as a SQL function, inlined by the optimizer."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)")


def register_expand_props(spark: SparkSession, name: str = "expand_props") -> None:
    """Rows from a JSON object as a SQL table function."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(j STRING) RETURNS TABLE (prop STRING, val INT)
            RETURN SELECT e.key, e.value FROM (SELECT explode(from_json(j, 'MAP<STRING, INT>'))) AS e(key, value)"""
    )


def vectorised(fn: Callable[[pd.Series], pd.Series], kind: str = "double"):
    """Escape hatch for logic without a built-in: Arrow batches, never single rows."""

    def run(s: pd.Series) -> pd.Series:
        return fn(s)

    return F.pandas_udf(run, kind)


def own_aggregate(df: DataFrame, by: Sequence[str], partial: Mapping[str, Column], finish: Column, out: str) -> DataFrame:
    """User-defined aggregate from mergeable built-in parts and a closing expression.

    The parts combine on the map side; a Python aggregate would need each whole group in one task.
    """
    g = df.groupBy(*by).agg(*[c.alias(n) for n, c in partial.items()])
    return g.select(*by, finish.alias(out))


def explode_props(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """Rows from a JSON object column."""
    return df.select(*keep, F.explode(F.from_json(col, "map<string,int>")).alias("prop", "val"))
