"""Data-quality rules, suites, gates and quarantine.

Row rules are boolean Columns: all row rules of a table are evaluated in one
aggregate. Key, reference and group rules each build their own small result.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.functions.columns import micros, safe_div
from tidemark.operators.aggregate import percentiles
from tidemark.session import settle

# Minimum completeness by criticality, in percent.
COMPLETENESS_BY_CRITICALITY = {"critical": 99.9, "important": 99.0, "informational": 95.0}

RESULT_COLUMNS = ["rule", "table", "column", "check_type", "criticality", "observed_value", "threshold", "passed"]


@dataclass(frozen=True)
class RowRule:
    """``ok`` must hold for rows in ``scope``; at most ``max_failed_pct`` percent may fail."""

    name: str
    column: str
    check_type: str
    ok: Column
    max_failed_pct: float = 0.0
    max_failed: int | None = None
    scope: Column | None = None
    criticality: str = "critical"

    def failed(self) -> Column:
        bad = ~F.coalesce(self.ok, F.lit(False))
        return bad if self.scope is None else (F.coalesce(self.scope, F.lit(False)) & bad)

    def relevant(self) -> Column:
        return F.lit(True) if self.scope is None else F.coalesce(self.scope, F.lit(False))


@dataclass(frozen=True)
class SetRule:
    """``build(tables, table)`` gives one row: observed_value double, passed boolean."""

    name: str
    column: str
    check_type: str
    threshold: str
    build: Callable[[Mapping[str, DataFrame], DataFrame], DataFrame]
    criticality: str = "critical"


# --- row rules ----------------------------------------------------------------


def completeness(col: str, sentinels: Sequence = (), min_pct: float | None = None, criticality="critical") -> RowRule:
    ok = F.col(col).isNotNull()
    if sentinels:
        ok = ok & ~F.col(col).isin(*sentinels)
    need = COMPLETENESS_BY_CRITICALITY[criticality] if min_pct is None else min_pct
    return RowRule(f"completeness:{col}", col, "completeness", ok, 100 - need, criticality=criticality)


def not_null(cols: Sequence[str], criticality="critical", max_failed_pct: float = 0.0) -> list[RowRule]:
    return [RowRule(f"not_null:{c}", c, "not_null", F.col(c).isNotNull(), max_failed_pct, criticality=criticality) for c in cols]


def accepted(col: str, values: Sequence, max_failed_pct=0.0, criticality="critical") -> RowRule:
    known = F.col(col).isNotNull()
    return RowRule(f"accepted:{col}", col, "accepted_values", F.col(col).isin(*values), max_failed_pct, None, known, criticality)


def in_range(col: str, lo=None, hi=None, max_failed_pct=0.0, criticality="critical") -> RowRule:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col(col) >= lo)
    if hi is not None:
        ok = ok & (F.col(col) <= hi)
    return RowRule(f"range:{col}", col, "range", ok, max_failed_pct, None, F.col(col).isNotNull(), criticality)


def pattern(col: str, regex: str, max_failed_pct=0.0, criticality="critical") -> RowRule:
    known = F.col(col).isNotNull()
    return RowRule(f"pattern:{col}", col, "pattern", F.col(col).rlike(regex), max_failed_pct, None, known, criticality)


def max_length(col: str, n: int, criticality="critical") -> RowRule:
    known = F.col(col).isNotNull()
    return RowRule(f"max_length:{col}", col, "max_length", F.length(col) <= n, 0.0, None, known, criticality)


def invariant(name: str, expr: Column, max_failed_pct=0.0, max_failed=None, criticality="critical") -> RowRule:
    return RowRule(name, "", "invariant", expr, max_failed_pct, max_failed, None, criticality)


def implies(a: Column, b: Column) -> Column:
    return ~F.coalesce(a, F.lit(False)) | b


def expression_match(name: str, left: Column, right: Column, tol: float, max_failed_pct=0.0, criticality="important"):
    return RowRule(name, "", "expression_match", F.abs(left - right) <= tol, max_failed_pct, None, None, criticality)


def in_order(cols: Sequence[str]) -> Column:
    """Milestones that are present follow each other in time; missing steps are skipped."""
    present = F.array_compact(F.array(*[F.col(c) for c in cols]))
    return present == F.array_sort(present)


def ordered(cols: Sequence[str], max_failed: int | None = None, criticality="critical") -> RowRule:
    return RowRule(f"ordered:{','.join(cols)}", "", "event_order", in_order(cols), 0.0, max_failed, None, criticality)


def freshness_pct(ts: str, loaded: str, minutes: int, pct: float, criticality="critical", max_failed: int | None = None) -> RowRule:
    ok = micros(loaded) - micros(ts) <= minutes * 60_000_000
    return RowRule(f"freshness:{ts}", ts, "freshness", ok, 100 - pct, max_failed, criticality=criticality)


# --- set rules ------------------------------------------------------------------


def _verdict(df: DataFrame, observed: Column, passed: Column) -> DataFrame:
    return df.select(observed.cast("double").alias("observed_value"), F.coalesce(passed, F.lit(False)).alias("passed"))


def unique(cols: Sequence[str], expected_dup_pct: float = 0.0, tol_pp: float = 0.1, criticality="critical", max_duplicates: int = 0) -> SetRule:
    """At most ``max_duplicates`` duplicate keys, or a known duplicate rate within ``tol_pp`` percentage points."""

    def build(_, df):
        n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        s = n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
        if expected_dup_pct == 0:
            return _verdict(s, F.col("d"), F.col("d") <= max_duplicates)
        rate = safe_div(100 * F.col("d"), "t", 0)
        return _verdict(s, F.round(rate, 6), F.abs(rate - expected_dup_pct) <= tol_pp)

    limit = f"{max_duplicates} duplicates" if expected_dup_pct == 0 else f"{expected_dup_pct}% +- {tol_pp}pp"
    return SetRule(f"unique:{','.join(cols)}", ",".join(cols), "uniqueness", limit, build, criticality)


def foreign_key(col: str, parent: str, parent_col: str, ignore_null=True, max_orphans=0, criticality="critical"):
    def build(tables, df):
        keys = tables[parent].select(F.col(parent_col).alias("_pk"))
        child = df.select(col)
        lost = child.filter(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_pk"), "left_anti")
        n = lost.agg(F.count(F.lit(1)).alias("n"))
        if not ignore_null:
            nulls = child.filter(F.col(col).isNull()).agg(F.count(F.lit(1)).alias("n"))
            n = n.unionByName(nulls).agg(F.sum("n").alias("n"))
        return _verdict(n, F.col("n"), F.col("n") <= max_orphans)

    return SetRule(f"foreign_key:{col}", col, "foreign_key", f"<= {max_orphans} orphans", build, criticality)


def in_reference(col: str, ref: str, ref_col: str, criticality="important") -> SetRule:
    base = foreign_key(col, ref, ref_col, criticality=criticality)
    return replace(base, name=f"in_reference:{col}", check_type="reference_membership")


def ri_late(fact: DataFrame, fk: str, dim: DataFrame, pk: str, ts: str, as_of: str, grace_hours: float) -> DataFrame:
    """Orphans split into rows still within the grace window and true misses."""
    from tidemark.operators.joins import orphans

    age = (micros(F.lit(as_of).cast("timestamp_ntz")) - micros(ts)) / F.lit(3.6e9)
    kind = F.when(age <= grace_hours, "late_arriving").otherwise("missing")
    return orphans(fact, fk, dim, pk).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(fk)).alias("n_keys")
    )


def group_mean_range(
    value: str, by: str, bands: Mapping[str, tuple[float, float, int]], criticality="important", where: Column | None = None
):
    """Group means inside (low, high), each with at least the stated rows; of the rows ``where`` holds, if given."""

    def build(_, df):
        df = df if where is None else df.filter(where)
        bad = F.lit(0)
        for name, (lo, hi, rows) in bands.items():
            here = F.col(by) == name
            mean, n = F.avg(F.when(here, F.col(value))), F.count(F.when(here & F.col(value).isNotNull(), 1))
            bad = bad + F.when((n >= rows) & mean.between(lo, hi), 0).otherwise(1)
        return _verdict(df.agg(bad.alias("bad")), F.col("bad"), F.col("bad") == 0)

    return SetRule(f"group_mean:{value}", value, "group_mean_range", "all groups in band", build, criticality)


def partition_ready(
    col: str, min_rows: int, start: str, days: int, criticality="critical", loaded: str | None = None, ready_by: str | None = None
) -> SetRule:
    """Each of ``days`` days from ``start`` holds at least ``min_rows`` rows.

    With ``ready_by`` (HH:MM:SS) only rows count whose ``loaded`` time is at or before
    that time of the following day.
    """

    def build(_, df):
        day = F.col(col).cast("date")
        lo = F.lit(start).cast("date")
        inside = df.filter((F.col(col) >= F.lit(start).cast("timestamp_ntz")) & (day < F.date_add(lo, days)))
        if ready_by is not None:
            due = F.concat(F.date_add(day, 1).cast("string"), F.lit(f" {ready_by}")).cast("timestamp_ntz")
            inside = inside.filter(F.col(loaded) <= due)
        counts = inside.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        ok = counts.agg(F.count(F.when(F.col("n") >= min_rows, 1)).alias("ok"))
        return _verdict(ok, F.lit(days) - F.col("ok"), F.col("ok") == days)

    return SetRule(f"partition_ready:{col}", col, "partition_availability", f">= {min_rows} rows a day", build, criticality)


def custom_sql(
    name: str, sql: str, max_count: float | None = None, criticality="critical", max_pct: float | None = None, entity: str | None = None
) -> SetRule:
    """A query over the suite's tables whose single number must not exceed ``max_count``.

    Tables are named plainly or as ``{table}``. With ``max_pct`` the number may be that
    share, in percent, of the distinct values of ``entity`` in the rule's table.
    """

    def build(tables, df):
        used = {name: frame for name, frame in tables.items() if re.search(rf"\b{re.escape(name)}\b", sql)}
        text = sql.strip()
        for name in used:  # a schema in front of a listed table goes
            text = re.sub(rf"(?i)\b(from|join)(\s+)(?:\w+\.)+{re.escape(name)}\b", rf"\1\2{name}", text)
        views = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in used)
        own = re.match(r"(?i)with\s", text)
        text = f"WITH {views}{', ' + text[own.end() :] if own else ' ' + text}" if views else text
        one = df.sparkSession.sql(text, **used)
        value = F.col(one.columns[0])
        if max_pct is None:
            return _verdict(one, value, value <= max_count)
        entities = df.agg(F.count_distinct(F.col(entity))).scalar()
        rate = safe_div(100 * value, entities, 0)
        return _verdict(one, rate, (rate <= max_pct) & (F.lit(True) if max_count is None else value <= max_count))

    limit = f"<= {max_count}" if max_pct is None else f"<= {max_pct}% of {entity}"
    return SetRule(name, "", "custom_sql", limit, build, criticality)


def timeliness(ts: str, as_of: str, lag_hours: float, future_h: float = 24, closed_before: str | None = None, criticality="critical"):
    """Newest row within ``lag_hours``; no rows far in the future or in closed periods."""

    def build(_, df):
        now = F.lit(as_of).cast("timestamp_ntz")
        lag = (micros(now) - micros(F.max(ts))) / F.lit(3.6e9)
        future = F.count(F.when(micros(ts) > micros(now) + int(future_h * 3.6e9), 1))
        closed = F.lit(0)
        if closed_before is not None:
            closed = F.count(F.when(F.col(ts) < F.lit(closed_before).cast("timestamp_ntz"), 1))
        s = df.agg(lag.alias("lag"), future.alias("future"), closed.alias("closed"))
        return _verdict(s, F.round("lag", 6), (F.col("lag") <= lag_hours) & (F.col("future") == 0) & (F.col("closed") == 0))

    return SetRule(f"timeliness:{ts}", ts, "timeliness", f"<= {lag_hours} h", build, criticality)


def bridge_balanced(key: str, weight: str, tol: float = 1e-6, criticality="critical") -> SetRule:
    def build(_, df):
        s = df.groupBy(key).agg(F.sum(weight).alias("w"))
        bad = s.agg(F.count(F.when(~F.coalesce(F.abs(F.col("w") - 1) <= tol, F.lit(False)), 1)).alias("n"))
        return _verdict(bad, F.col("n"), F.col("n") == 0)

    return SetRule(f"bridge_balanced:{key}", weight, "bridge_balanced", "weights sum to 1", build, criticality)


def tables_agree(other: str, by: Sequence[str], col: str, tol: float, criticality="important") -> SetRule:
    """Grouped sums of two tables differ by at most ``tol``; counts groups that do not."""

    def build(tables, df):
        from tidemark.operators.reconcile import reconcile_by

        diff = reconcile_by(df, tables[other], by, [col])
        bad = diff.agg(F.count(F.when(F.abs(F.coalesce(F.col(f"{col}_residual"), F.lit(1e308))) > tol, 1)).alias("n"))
        return _verdict(bad, F.col("n"), F.col("n") == 0)

    return SetRule(f"tables_agree:{col}", col, "cross_table", f"<= {tol}", build, criticality)


def row_count(lo: int, hi: int | None = None, criticality="critical") -> SetRule:
    def build(_, df):
        s = df.agg(F.count(F.lit(1)).alias("n"))
        ok = F.col("n") >= lo
        return _verdict(s, F.col("n"), ok if hi is None else ok & (F.col("n") <= hi))

    return SetRule("row_count", "", "row_count", f"{lo}..{'' if hi is None else hi}", build, criticality)


def sum_matches(col: str, other: str, other_col: str, tol: float = 0.01, criticality="critical") -> SetRule:
    def build(tables, df):
        ref = tables[other].agg(F.sum(F.col(other_col).cast("decimal(18,2)"))).scalar()
        s = df.agg(F.sum(F.col(col).cast("decimal(18,2)")).alias("s")).select((F.col("s") - ref).alias("d"))
        return _verdict(s, F.col("d"), F.abs("d") <= tol)

    return SetRule(f"sum_matches:{col}", col, "sum_matches", f"<= {tol}", build, criticality)


# --- suites -----------------------------------------------------------------------


def evaluate_row_rules(df: DataFrame, rules: Sequence[RowRule], table: str) -> DataFrame:
    """All row rules of a table in one scan: one result row per rule."""
    out = []
    for r in rules:
        failed, n = F.count(F.when(r.failed(), 1)), F.count(F.when(r.relevant(), 1))
        pct = F.round(safe_div(100.0 * failed, n, 0), 6)
        if r.max_failed is not None:
            observed, ok, limit = failed.cast("double"), failed <= r.max_failed, f"<= {r.max_failed} rows"
        else:
            observed, ok, limit = pct, pct <= r.max_failed_pct, f"<= {round(r.max_failed_pct, 6):g}% failed"
        out.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(table).alias("table"),
                F.lit(r.column).alias("column"),
                F.lit(r.check_type).alias("check_type"),
                F.lit(r.criticality).alias("criticality"),
                observed.alias("observed_value"),
                F.lit(limit).alias("threshold"),
                ok.alias("passed"),
            )
        )
    return df.agg(F.array(*out).alias("r")).select(F.inline("r"))


def run_suite(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[RowRule | SetRule]], now: dt.datetime | None = None
) -> DataFrame:
    """Evaluate all rules; one row per rule, ready to append to ``dq_results``."""
    parts = []
    for table, listed in rules.items():
        df = tables[table]
        rows = [r for r in listed if isinstance(r, RowRule)]
        if rows:
            parts.append(evaluate_row_rules(df, rows, table))
        for r in listed:
            if isinstance(r, SetRule):
                parts.append(
                    r.build(tables, df).select(
                        F.lit(r.name).alias("rule"),
                        F.lit(table).alias("table"),
                        F.lit(r.column).alias("column"),
                        F.lit(r.check_type).alias("check_type"),
                        F.lit(r.criticality).alias("criticality"),
                        "observed_value",
                        F.lit(r.threshold).alias("threshold"),
                        "passed",
                    )
                )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if now is None else out.withColumn("checked_at", F.lit(now).cast("timestamp_ntz"))


def decide(results: DataFrame, policy: Mapping[str, str]) -> DataFrame:
    """``policy`` maps criticality to block / warn / ignore; one row with the decision."""
    action = F.lit("block")
    for level, act in policy.items():
        action = F.when(F.col("criticality") == level, act).otherwise(action)
    failed = results.filter(~F.col("passed")).withColumn("action", action)
    s = failed.agg(
        F.count(F.when(F.col("action") == "block", 1)).alias("n_block"),
        F.count(F.when(F.col("action") == "warn", 1)).alias("n_warn"),
    )
    verdict = F.when(F.col("n_block") > 0, "blocked").when(F.col("n_warn") > 0, "published_with_warnings")
    return s.withColumn("decision", verdict.otherwise("published"))


def publish_if_ok(df: DataFrame, path: str, results: DataFrame, policy: Mapping[str, str]) -> str:
    """Write ``df`` only if no blocking rule failed; returns the decision."""
    decision = decide(results, policy).first()["decision"]
    if decision != "blocked":
        df.write.mode("errorifexists").parquet(path)
    return decision


def failed_rules(rules: Sequence[RowRule]) -> Column:
    """Names of the row rules a row breaks."""
    return F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules]))


def quarantine(df: DataFrame, rules: Sequence[RowRule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``failed_rules``)."""
    marked = df.withColumn("failed_rules", failed_rules(rules))
    good = marked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    return good, marked.filter(F.size("failed_rules") > 0)


def schema_diff(df: DataFrame, locked: T.StructType, critical: Sequence[str] = ()) -> DataFrame:
    """Schema changes against a locked schema, each fail or warn."""
    order = ["tinyint", "smallint", "int", "bigint", "decimal", "float", "double"]

    def rank(kind):
        name = kind.simpleString().split("(")[0]
        return order.index(name) if name in order else None

    now = {f.name: f for f in df.schema.fields}
    rows = []
    for f in locked.fields:
        strict = not critical or f.name in critical
        if f.name not in now:
            rows.append((f.name, "removed", "fail" if strict else "warn"))
            continue
        g = now[f.name]
        if g.dataType != f.dataType:
            a, b = rank(f.dataType), rank(g.dataType)
            wider = a is not None and b is not None and b > a
            if isinstance(f.dataType, T.DecimalType) and isinstance(g.dataType, T.DecimalType):
                whole = g.dataType.precision - g.dataType.scale >= f.dataType.precision - f.dataType.scale
                wider = whole and g.dataType.scale >= f.dataType.scale
            rows.append((f.name, "widened" if wider else "narrowed", "warn" if wider else "fail"))
        if g.nullable and not f.nullable:
            rows.append((f.name, "became_nullable", "fail" if strict else "warn"))
    known = {f.name for f in locked.fields}
    rows += [(n, "added", "warn") for n in now if n not in known]
    return df.sparkSession.createDataFrame(rows, "column string, change string, severity string")


def dq_dashboard(results: DataFrame, ts: str = "checked_at") -> DataFrame:
    """Daily pass rate per criticality."""
    day = F.col(ts).cast("date").alias("day")
    return results.groupBy(day, "criticality").agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count(F.when(F.col("passed"), 1)).alias("n_passed"),
        F.round(safe_div(100.0 * F.count(F.when(F.col("passed"), 1)), F.count(F.lit(1))), 6).alias("pass_pct"),
    )


def top_failing(results: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    failed = results.filter(~F.col("passed")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_failed"))
    return failed.orderBy(F.desc("n_failed"), *by).limit(n)


def time_to_repair(results: DataFrame, rule: Sequence[str], ts: str = "checked_at") -> DataFrame:
    """Hours from the first failure of an incident to the next pass, per rule."""
    from tidemark.operators.ordered import neighbour

    prev = neighbour(results, rule, [ts], {"_was": "passed"}, step=-1)
    edges = prev.filter(F.col("_was").isNull() | (F.col("_was") != F.col("passed")))
    edges = edges.filter(~F.col("passed") | F.col("_was").isNotNull()).select(*rule, ts, "passed")
    nxt = neighbour(settle(edges, "incident-edges"), rule, [ts], {"repaired_at": ts}, step=1)
    hours = (micros("repaired_at") - micros(ts)) / F.lit(3.6e9)
    return nxt.filter(~F.col("passed")).select(*rule, F.col(ts).alias("failed_at"), "repaired_at", hours.alias("hours"))


def slo(results: DataFrame, target: float, warning: float, days: int, ts: str = "checked_at") -> DataFrame:
    """Rolling pass percentage over ``days`` days with its band."""
    day = F.col(ts).cast("date").alias("day")
    daily = results.groupBy(day).agg(F.count(F.when(F.col("passed"), 1)).alias("p"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)  # one row per day
    pct = F.round(safe_div(100.0 * F.sum("p").over(w), F.sum("n").over(w)), 6)
    status = F.when(F.col("pass_pct") < target, "breach").when(F.col("pass_pct") < warning, "warning").otherwise("ok")
    return daily.select("day", pct.alias("pass_pct")).withColumn("status", status)


def duration_slo(runs: DataFrame, by: Sequence[str], duration: str) -> DataFrame:
    return percentiles(runs, by, duration, {"p50": 0.5, "p95": 0.95})


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "rule string, table string, column string, check_type string, criticality string, "
        "observed_value double, threshold string, passed boolean"
    )
