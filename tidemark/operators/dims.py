"""Dimensional modelling: dates, keys, slowly changing dimensions, facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.functions.columns import date_key, fiscal, hash_diff, hash_key, money
from tidemark.operators.joins import join_scd2, orphans, star_join
from tidemark.operators.ordered import neighbour, running_sums
from tidemark.operators.reconcile import row_diff
from tidemark.session import settle, shuffle_width

UNKNOWN_KEY = -1
FROM, TO, CURRENT = "row_effective_from", "row_effective_to", "is_current"


# --- calendar -----------------------------------------------------------------


def dim_date(
    bounds: DataFrame, start: str, end: str, fiscal_start: int = 4, holidays: Sequence[str] = (), today: str | None = None
) -> DataFrame:
    """Calendar over one row of (start, end) dates; keys are YYYYMMDD style."""
    days = bounds.select(F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("date"))
    d = F.col("date")
    weekend = F.weekday(d) >= 5
    holiday = d.isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    year = F.year(d)
    cols = {
        "date_key": date_key(d),
        "date": d,
        "day_of_week": F.weekday(d) + 1,
        "day_name": F.date_format(d, "EEEE"),
        "day_of_month": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d),
        "week_key": F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d),
        "iso_week_of_year": F.weekofyear(d),
        "month_key": year * 100 + F.month(d),
        "month_name_short": F.date_format(d, "MMM"),
        "month_name": F.date_format(d, "MMMM"),
        "quarter_key": year * 10 + F.quarter(d),
        "quarter_name": F.concat(F.lit("Q"), F.quarter(d).cast("string")),
        "year": year,
        **fiscal(d, fiscal_start),
        "is_weekend": weekend,
        "is_holiday": holiday,
        "is_working_day": ~weekend & ~holiday,
    }
    if today is not None:
        cols["relative_days"] = F.datediff(d, F.lit(today).cast("date"))
    return days.select(*[c.alias(n) for n, c in cols.items()])


def dim_time(spark: SparkSession, unit: str = "minute") -> DataFrame:
    """1,440 minutes or 86,400 seconds of a day."""
    n, step = {"minute": (1440, 60), "second": (86400, 1)}[unit]
    sec = F.col("id") * step
    hour, minute = F.floor(sec / 3600), F.floor(sec % 3600 / 60)
    band = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    return spark.range(n).select(
        F.col("id").alias("time_key"), hour.cast("int").alias("hour"), minute.cast("int").alias("minute"),
        (sec % 60).cast("int").alias("second"), band.alias("day_part"),
    )


# --- keys -----------------------------------------------------------------------


def number_rows(df: DataFrame, keys: Sequence[str], out: str, start: Column | int = 1) -> DataFrame:
    """Dense numbers without a global sort in one task.

    Numeric first keys are numbered in order; other keys in hash order.
    """
    one = df.withColumn("_one", F.lit(1).cast("long"))
    first = keys[0]
    if isinstance(df.schema[first].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        numbered = running_sums(one, list(keys), {"_n": "_one"})
    else:
        n = shuffle_width(df.sparkSession)
        cut = one.withColumn("_h", F.pmod(F.xxhash64(*keys), F.lit(n)))
        w = W.partitionBy("_h").orderBy(*keys)
        sizes = cut.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
        before = W.orderBy("_h").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
        offset = sizes.select(F.col("_h").alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
        numbered = cut.withColumn("_r", F.row_number().over(w)).join(offset, F.col("_h") == F.col("_b"))
        numbered = numbered.withColumn("_n", F.col("_r") + F.col("_o")).drop("_h", "_b", "_o", "_r")
    base = F.lit(start) if isinstance(start, int) else start
    return numbered.withColumn(out, (F.col("_n") + base - 1).cast("long")).drop("_n", "_one")


def assign_keys(new: DataFrame, existing: DataFrame, bk: Sequence[str], sk: str) -> DataFrame:
    """Key map: known business keys keep theirs, new ones follow the current maximum."""
    known = existing.select(*bk, sk)
    fresh = new.select(*bk).distinct().join(known.select(*bk), list(bk), "left_anti")
    top = known.agg(F.coalesce(F.max(sk), F.lit(0)) + 1).scalar()
    return known.unionByName(number_rows(fresh, bk, sk, top).select(*bk, sk))


def with_unknown(dim: DataFrame, sk: str, label: str = "Unknown") -> DataFrame:
    """Add the -1 member: text columns say ``label``, the rest is NULL."""
    vals = []
    for f in dim.schema.fields:
        v = F.lit(UNKNOWN_KEY) if f.name == sk else F.lit(label) if isinstance(f.dataType, T.StringType) else F.lit(None)
        vals.append(v.cast(f.dataType).alias(f.name))
    return dim.unionByName(dim.sparkSession.range(1).select(*vals))


def resolve_fk(fact: DataFrame, fk: str, dim: DataFrame, bk: str, sk: str) -> DataFrame:
    return star_join(fact, {fk: (dim, bk, sk)}, UNKNOWN_KEY)


# --- slowly changing dimensions ------------------------------------------------------


def _paired(dim: DataFrame, src: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    left = dim.select(F.col(key).alias("_dk"), F.struct(*dim.columns).alias("_d"))
    right = src.select(F.col(key).alias("_sk"), F.struct(*[F.col(c) for c in cols]).alias("_s"))
    return left.join(right, F.col("_dk") == F.col("_sk"), "full")


def _differs(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | ~F.col(f"_d.{c}").eqNullSafe(F.col(f"_s.{c}"))
    return F.col("_dk").isNotNull() & F.col("_sk").isNotNull() & out


def scd0(dim: DataFrame, src: DataFrame, key: str) -> DataFrame:
    """First value stays for ever; only unknown keys are added."""
    fresh = src.join(dim.select(key), key, "left_anti")
    return dim.unionByName(fresh.select(*dim.columns))


def scd1(dim: DataFrame, src: DataFrame, key: str, cols: Sequence[str], ts: str) -> DataFrame:
    """Overwrite on change; ``created_at`` stays, ``updated_at`` moves only on a real change."""
    now = F.lit(ts).cast("timestamp_ntz")
    changed, fresh, seen = _differs(cols), F.col("_dk").isNull(), F.col("_sk").isNotNull()
    return _paired(dim, src, key, cols).select(
        F.coalesce("_dk", "_sk").alias(key),
        *[F.when(seen, F.col(f"_s.{c}")).otherwise(F.col(f"_d.{c}")).alias(c) for c in cols],
        F.when(fresh, now).otherwise(F.col("_d.created_at")).alias("created_at"),
        F.when(fresh | changed, now).otherwise(F.col("_d.updated_at")).alias("updated_at"),
    )


def scd2(dim: DataFrame, src: DataFrame, key: str, cols: Sequence[str], ts: str, close_missing: bool = False):
    """Close changed versions at ``ts`` and open new ones; one full join on current rows.

    Running it again with the same source changes nothing.
    """
    now = F.lit(ts).cast("timestamp_ntz")
    current, history = dim.filter(CURRENT), dim.filter(~F.col(CURRENT))
    open_end = F.lit(None).cast("timestamp_ntz")

    def version(side, start, end, live):
        return F.struct(
            F.coalesce("_dk", "_sk").alias(key),
            *[F.col(f"{side}.{c}").alias(c) for c in cols],
            start.alias(FROM), end.alias(TO), F.lit(live).alias(CURRENT),
        )

    kept = version("_d", F.col(f"_d.{FROM}"), F.col(f"_d.{TO}"), True)
    closed = version("_d", F.col(f"_d.{FROM}"), now, False)
    opened = version("_s", now, open_end, True)
    gone = F.col("_sk").isNull()
    rows = F.when(_differs(cols), F.array(closed, opened)).when(F.col("_dk").isNull(), F.array(opened))
    if close_missing:
        rows = rows.when(gone, F.array(closed))
    rows = rows.otherwise(F.array(kept))
    merged = _paired(current, src, key, cols).select(F.inline(rows))
    return history.select(key, *cols, FROM, TO, CURRENT).unionByName(merged)


def scd2_from_history(changes: DataFrame, key: str, cols: Sequence[str], ts: str) -> DataFrame:
    """Versions from a full change log: repeats collapse, equal times keep the greatest row."""
    last = changes.groupBy(key, ts).agg(F.max(F.struct(*cols)).alias("_v"))
    rows = last.select(key, ts, "_v.*").withColumn("_h", hash_diff(cols))
    flagged = neighbour(rows, [key], [ts], {"_was": "_h"}, step=-1)
    starts = flagged.filter(F.col("_was").isNull() | (F.col("_was") != F.col("_h"))).drop("_was", "_h")
    starts = settle(starts, "version-starts")
    spans = neighbour(starts, [key], [ts], {TO: ts}, step=1)
    return spans.select(key, *cols, F.col(ts).alias(FROM), TO, F.col(TO).isNull().alias(CURRENT))


def scd3(dim: DataFrame, src: DataFrame, key: str, col: str) -> DataFrame:
    """Current and previous value side by side; ``previous`` moves only on a change."""
    prev = f"previous_{col}"
    held = dim if prev in dim.columns else dim.withColumn(prev, F.lit(None).cast(dim.schema[col].dataType))
    moved = _differs([col])
    seen = F.col("_sk").isNotNull()
    return _paired(held.select(key, col, prev), src, key, [col]).select(
        F.coalesce("_dk", "_sk").alias(key),
        F.when(seen, F.col(f"_s.{col}")).otherwise(F.col(f"_d.{col}")).alias(col),
        F.when(moved, F.col(f"_d.{col}")).otherwise(F.col(f"_d.{prev}")).alias(prev),
    )


def scd4(dim: DataFrame, src: DataFrame, key: str, cols: Sequence[str], ts: str) -> tuple[DataFrame, DataFrame]:
    """(current dimension, history rows to append): replaced values move to history."""
    pair = _paired(dim.select(key, *cols), src, key, cols)
    seen = F.col("_sk").isNotNull()
    current = pair.select(
        F.coalesce("_dk", "_sk").alias(key),
        *[F.when(seen, F.col(f"_s.{c}")).otherwise(F.col(f"_d.{c}")).alias(c) for c in cols],
    )
    old = pair.filter(_differs(cols)).select(
        F.col("_dk").alias(key), *[F.col(f"_d.{c}").alias(c) for c in cols],
        F.lit(ts).cast("timestamp_ntz").alias("replaced_at"),
    )
    return current, old


def scd6(dim2: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """SCD 2 rows plus today's value of each column (and the previous version's value)."""
    live = dim2.filter(CURRENT).select(F.col(key).alias("_k"), *[F.col(c).alias(f"current_{c}") for c in cols])
    with_prev = neighbour(dim2, [key], [FROM], {f"previous_{c}": c for c in cols}, step=-1)
    return with_prev.join(live, F.col(key) == F.col("_k"), "left").drop("_k")


def check_scd2(dim: DataFrame, key: str) -> DataFrame:
    """Keys with a gap, an overlap or not exactly one current row."""
    nxt = neighbour(dim, [key], [FROM], {"_next": FROM}, step=1)
    return (
        nxt.groupBy(key)
        .agg(
            F.count(F.when(F.col("_next") > F.col(TO), 1)).alias("n_gaps"),
            F.count(F.when((F.col("_next") < F.col(TO)) | (F.col(TO).isNull() & F.col("_next").isNotNull()), 1)).alias("n_overlaps"),
            F.count(F.when(F.col(CURRENT), 1)).alias("n_current"),
        )
        .filter("n_gaps > 0 OR n_overlaps > 0 OR n_current <> 1")
    )


# --- facts -------------------------------------------------------------------------


def build_fact(
    src: DataFrame,
    dims: Mapping[str, tuple[DataFrame, str, str]],
    scd2_dims: Mapping[str, tuple[DataFrame, str, str]],
    ts: str,
    keep: Sequence[str],
    measures: Mapping[str, Column],
    dense: bool = False,
) -> DataFrame:
    """Star fact: type 1 keys, versioned keys valid at ``ts``, date key, typed measures.

    ``dims`` and ``scd2_dims`` map a fact column to (dimension, business key, surrogate key).
    Columns that the fact does not need are left out before rows are written or dealt.
    """
    out = star_join(src, dims, UNKNOWN_KEY)
    needed = dict.fromkeys([*keep, *[f"{fk}_key" for fk in dims], *scd2_dims, ts])
    out = out.select(*needed, *[m.alias(f"_m_{n}") for n, m in measures.items()])
    for fk, (dim, bk, sk) in scd2_dims.items():
        side = dim.select(F.col(bk).alias("_dim_bk"), F.col(sk).alias("_dim_sk"), FROM, TO)
        out = join_scd2(out, side, fk, ts, dim_bk="_dim_bk", dense=dense)
        out = out.withColumn(f"{fk}_version_key", F.coalesce("_dim_sk", F.lit(UNKNOWN_KEY).cast(side.schema["_dim_sk"].dataType)))
        out = out.drop("_dim_sk")
    keys = [f"{fk}_key" for fk in dims] + [f"{fk}_version_key" for fk in scd2_dims]
    return out.select(*keep, *keys, date_key(ts).alias("date_key"), *[F.col(f"_m_{n}").alias(n) for n in measures])


def periodic_snapshot(moves: DataFrame, key: str, date: str, qty: Column | str, until: Column | None = None):
    """Balance per key and day from movements, from the key's first day to the last day overall."""
    q = F.col(qty) if isinstance(qty, str) else qty
    daily = settle(moves.groupBy(key, F.col(date).cast("date").alias("day")).agg(F.sum(q).alias("moved")), "daily")
    last = daily.agg(F.max("day")).scalar() if until is None else until
    spine = daily.groupBy(key).agg(F.min("day").alias("_a")).withColumn("_b", last)
    spine = spine.select(F.col(key).alias("_k"), F.explode(F.sequence("_a", "_b")).alias("_d"))
    full = spine.join(daily, (F.col("_k") == F.col(key)) & (F.col("_d") == F.col("day")), "left")
    w = W.partitionBy("_k").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)  # at most one row per calendar day
    moved = F.coalesce("moved", F.lit(0))
    return full.select(F.col("_k").alias(key), F.col("_d").alias("day"), moved.alias("moved"), F.sum(moved).over(w).alias("balance"))


def accumulating_snapshot(events: DataFrame, key: str, step: str, ts: str, steps: Sequence[str]) -> DataFrame:
    """First time of each milestone per key, day lags between neighbours, latest status."""
    firsts = [F.min(F.when(F.col(step) == s, F.col(ts))).alias(f"{s}_at") for s in steps]
    out = events.groupBy(key).agg(*firsts)
    lags = {f"days_{a}_to_{b}": F.datediff(F.col(f"{b}_at"), F.col(f"{a}_at")) for a, b in zip(steps, steps[1:], strict=False)}
    status = F.lit("none")
    for s in steps:
        status = F.when(F.col(f"{s}_at").isNotNull(), s).otherwise(status)
    return out.withColumns(lags).withColumn("status", status)


def factless(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def did_not_happen(coverage: DataFrame, happened: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered combinations without an event."""
    return coverage.select(*keys).distinct().join(happened.select(*keys), list(keys), "left_anti")


def allocate(fact: DataFrame, bridge: DataFrame, key: str, measure: str, weight: str) -> DataFrame:
    """Measure spread over bridge rows by exact decimal weights, so totals are preserved."""
    w = F.col(weight).cast("decimal(9,8)")
    return fact.join(bridge, key).withColumn("allocated", money(measure) * w)


def junk_dim(fact: DataFrame, flags: Sequence[str], sk: str = "junk_key") -> tuple[DataFrame, DataFrame]:
    """(dimension of occurring flag combinations, fact with the key instead of the flags).

    The key is a hash of the flags, so the fact needs no join to get it.
    """
    keyed = fact.withColumn(sk, hash_key(flags))
    return keyed.select(sk, *flags).distinct(), keyed.drop(*flags)


def role_play(fact: DataFrame, dim_date_df: DataFrame, roles: Mapping[str, str], attrs: Sequence[str]) -> DataFrame:
    """Join one date dimension once per role: ``{role: fact date key}``."""
    out = fact
    for role, fk in roles.items():
        side = dim_date_df.select(F.col("date_key").alias(f"_k_{role}"), *[F.col(a).alias(f"{role}_{a}") for a in attrs])
        out = out.join(side, F.col(fk) == F.col(f"_k_{role}"), "left").drop(f"_k_{role}")
    return out


def flatten_dim(dim: DataFrame, parents: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Snowflake to star: ``[(parent, child column, parent key)]`` in order."""
    out = dim
    for parent, child, key in parents:
        out = out.join(parent, F.col(child) == F.col(key), "left")
    return out


def semi_additive(snap: DataFrame, entity: Sequence[str], date: str, val: str, by: Mapping[str, Column]) -> DataFrame:
    """Last balance per entity and period, then summed over entities."""
    groups = [c.alias(n) for n, c in by.items()]
    last = snap.groupBy(*entity, *groups).agg(F.max_by(val, date).alias("_v"))
    return last.groupBy(*by).agg(F.sum("_v").alias("closing"))


def inferred_members(fact: DataFrame, fk: str, dim: DataFrame, bk: str, label: str = "Inferred") -> DataFrame:
    """Placeholder rows for keys that arrived before their dimension record."""
    missing = orphans(fact.select(fk), fk, dim, bk).distinct()
    vals = []
    for f in dim.schema.fields:
        v = F.col(fk) if f.name == bk else F.lit(label) if isinstance(f.dataType, T.StringType) else F.lit(None)
        vals.append(v.cast(f.dataType).alias(f.name))
    flagged = missing.select(*vals, F.lit(True).alias("is_inferred"))
    return dim.withColumn("is_inferred", F.lit(False)).unionByName(flagged)


def with_audit(df: DataFrame, batch: str, source: str, now: dt.datetime) -> DataFrame:
    return df.withColumns(
        {
            "_batch_id": F.lit(batch),
            "_source": F.lit(source),
            "_loaded_at": F.lit(now).cast("timestamp_ntz"),
            "_row_hash": hash_key(df.columns),
        }
    )


def conformed(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Members that differ between two marts' versions of one dimension."""
    return row_diff(a.select(key, *cols), b.select(key, *cols), [key])
