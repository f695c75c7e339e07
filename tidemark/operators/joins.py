"""Joins.

No join here carries a broadcast hint: Spark broadcasts a side only when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
sorts and merges, splitting hot keys through adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import micros
from tidemark.operators.intervals import contained
from tidemark.operators.ordered import carry_forward, running_sums
from tidemark.session import settle


def left_join_on(
    df: DataFrame, other: DataFrame, left_on: str, right_on: str, right_filter: Column | None = None
) -> DataFrame:
    """Left join whose right-side predicate belongs to ON, so it removes no left row."""
    right = other if right_filter is None else other.filter(right_filter)
    return df.join(right, F.col(left_on) == F.col(right_on), "left")


BROADCAST_ROWS = 1 << 19


def unless_long(lookup: DataFrame) -> DataFrame:
    """A lookup that is merged, not broadcast, if it has very many rows.

    The planner sizes a table by its files, which hold keys and repeated values in a tenth
    of the memory that a broadcast takes on the driver; so rows are counted.
    """
    return lookup.hint("merge") if lookup.count() > BROADCAST_ROWS else lookup


def star_join(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]], unknown: int = -1) -> DataFrame:
    """Resolve business keys: ``{fact column: (dim, business key, surrogate key)}``."""
    out = fact
    for fk, (dim, bk, sk) in dims.items():
        lookup = unless_long(dim.select(F.col(bk).alias(f"_bk_{fk}"), F.col(sk).alias(f"_sk_{fk}")))
        out = out.join(lookup, F.col(fk) == F.col(f"_bk_{fk}"), "left")
        out = out.withColumn(f"{fk}_key", F.coalesce(f"_sk_{fk}", F.lit(unknown))).drop(f"_bk_{fk}", f"_sk_{fk}")
    return out


def full_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join of two keyed tables with the side each key is present on."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("_b"))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return left.join(right, list(keys), "full").withColumn("side", side).drop("_a", "_b")


def cross_spine(keys: DataFrame, start: str, end: str, step: str = "1 day", name: str = "period") -> DataFrame:
    """Every key with every period: each key row unfolds its own calendar.

    ``start`` and ``end`` are inclusive dates or names of date columns on ``keys``.
    """

    def bound(v):
        return F.col(v) if v in keys.columns else F.lit(v).cast("date")

    days = F.sequence(bound(start), bound(end), F.expr(f"INTERVAL {step}"))
    return keys.withColumn(name, F.explode(days))


def join_nullsafe(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL matches NULL."""
    right = b.select([F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.join(right, cond, how).drop(*[f"_r_{c}" for c in cols])


def orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Fact rows with a non-NULL key that the dimension lacks."""
    members = dim.select(F.col(pk).alias("_pk"))
    return fact.filter(F.col(fk).isNotNull()).join(members, F.col(fk) == F.col("_pk"), "left_anti")


def semi(df: DataFrame, keys: DataFrame, on: str, key: str) -> DataFrame:
    """EXISTS: no row is multiplied however often a key repeats."""
    return df.join(keys.select(F.col(key).alias("_key")), F.col(on) == F.col("_key"), "left_semi")


def join_scd2(
    fact: DataFrame,
    dim: DataFrame,
    bk: str,
    ts: str,
    dim_bk: str | None = None,
    valid_from: str = "row_effective_from",
    valid_to: str = "row_effective_to",
    how: str = "left",
    dense: bool = False,
) -> DataFrame:
    """Version valid at the fact time: equal key and half-open range; NULL end is open.

    Versions may overlap; a fact then has a row for each. Facts and versions meet in the cells
    of a dyadic cover (``operators/intervals.py``), so a key with very many of both is no
    problem; only key, time and a row number of the facts unfold, and the facts are
    written once. ``dense`` takes the as-of path instead, which reads each side once; it
    relies on versions that do not overlap.
    """
    if dense:
        attrs = [c for c in dim.columns if c not in (dim_bk or bk, valid_from)]
        side = dim.withColumnsRenamed({dim_bk or bk: bk}) if (dim_bk or bk) != bk else dim
        hit = asof_join(fact, side, [bk], ts, valid_from, attrs)
        live = F.col(f"matched_{valid_from}").isNotNull() & (F.col(valid_to).isNull() | (F.col(ts) < F.col(valid_to)))
        kept = {c: F.when(live, F.col(c)) for c in attrs if c != valid_to}
        out = hit.filter(live) if how == "inner" else hit.withColumns(kept)
        return out.drop(f"matched_{valid_from}", valid_to)
    rows = settle(fact.withColumn("_id", F.monotonically_increasing_id()), "facts")
    points = rows.select("_id", F.col(bk).alias("_key"), micros(ts).alias("_at"))
    last = points.agg(F.max("_at")).scalar() + 1
    start, end = micros(valid_from), micros(valid_to)
    attrs = [c for c in dim.columns if c not in (dim_bk or bk, valid_from, valid_to)]
    versions = dim.select(
        F.col(dim_bk or bk).alias("_bk"), start.alias("_from"), F.coalesce(end, F.greatest(last, start + 1)).alias("_to"), F.struct(*attrs).alias("_v")
    )
    versions = settle(versions, "versions")  # read for the levels and for the join
    found = contained(points, versions, {"_key": "_bk"}, "_at", "_from", "_to").select("_id", "_v")
    out = rows.join(found.hint("merge"), "_id", how)  # both grow with the facts
    return out.select(*fact.columns, *[F.col(f"_v.{c}").alias(c) for c in attrs])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tolerance: str | None = None,
) -> DataFrame:
    """Latest right row at or before each left row, per key; linear, no range join.

    Both sides are stacked and the last right row is carried forward along time
    ranges, so a key holding much of the data is spread over many tasks. Equal
    right times resolve to the greatest values.
    """
    lcols = list(left.columns)
    payload = F.struct(F.col(right_ts).alias("ts"), *[F.col(v).alias(v) for v in values])
    newest = right.groupBy(*by, right_ts).agg(F.max(payload).alias("_p"))
    a = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_row"))
    b = newest.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), "_p")
    stacked = a.unionByName(b, allowMissingColumns=True)
    filled = carry_forward(stacked, by, ["_ts", "_side"], {"_last": "_p"}).filter("_side = 1")
    found = F.col("_last")
    if tolerance is not None:
        near = F.col("_last.ts") >= F.col("_ts") - F.expr(f"INTERVAL {tolerance}")
        found = F.when(near, F.col("_last"))
    out = filled.select("_row.*", found.alias("_m"))
    return out.select(*lcols, F.col("_m.ts").alias(f"matched_{right_ts}"), *[F.col(f"_m.{v}").alias(v) for v in values])


def interval_agg(
    cycles: DataFrame,
    readings: DataFrame,
    cycle_key: Sequence[str],
    on: Sequence[str],
    start: str,
    end: str,
    ts: str,
    aggs: Mapping[str, Column],
) -> DataFrame:
    """Aggregate readings inside each [start, end) interval.

    Readings and intervals meet in the cells of a dyadic cover, whatever the overlap.
    An interval without readings, or with a NULL bound, is aggregated over one row of NULLs.
    """
    keys = list(dict.fromkeys([*cycle_key, *on, start, end]))
    spans = cycles.select(*keys)
    marked = spans.withColumns({"_from": micros(start), "_to": micros(end)})
    points = readings.withColumnsRenamed({k: f"_r_{k}" for k in on}).withColumn("_at", micros(ts))
    pairs = contained(points, marked, {f"_r_{k}": k for k in on}, "_at", "_from", "_to").drop("_from", "_to", "_at")
    # a row of NULLs for every interval keeps those without readings and leaves both sides of the join free to be split
    return pairs.unionByName(spans, allowMissingColumns=True).groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])


def interval_sums(
    cycles: DataFrame,
    readings: DataFrame,
    cycle_key: Sequence[str],
    on: Sequence[str],
    start: str,
    end: str,
    ts: str,
    sums: Mapping[str, str],
    count: str = "n_readings",
    scale: int = 24,
) -> DataFrame:
    """Exact sums and count of readings inside each [start, end) without pairing them.

    Whole numbers and decimals keep all their digits. A double is summed in two parts, its
    whole part (below 1e37) and the rest to ``scale`` digits behind the point, and comes back as a
    double. Interval bounds are placed among the readings in time order; a sum is the running
    total at the end minus the one at the start. Linear for any overlap and any hot key.
    """
    keys = list(dict.fromkeys([*cycle_key, *on, start, end]))
    parts: dict[str, Column] = {}
    for o, c in sums.items():
        kind, value = readings.schema[c].dataType, F.col(c)
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            rest = value.cast("double") % F.lit(1.0)  # exact
            parts |= {f"_whole_{o}": (value.cast("double") - rest).cast("decimal(38,0)"), f"_rest_{o}": rest.cast(f"decimal(38,{scale})")}
        else:
            parts[f"_whole_{o}"] = value.cast(f"decimal(38,{kind.scale if isinstance(kind, T.DecimalType) else 0})")
    points = readings.select(*on, F.col(ts).alias("_t"), F.lit(1).alias("_side"), *[c.alias(n) for n, c in parts.items()], F.lit(1).cast("long").alias("_one"))
    points = points.fillna(0, list(parts))
    bounds = F.array(
        F.struct(F.col(start).alias("_t"), F.lit(-1).alias("_sign")),
        F.struct(F.greatest(F.col(start), F.col(end)).alias("_t"), F.lit(1).alias("_sign")),
    )
    marks = cycles.select(*keys, F.struct(*keys).alias("_cycle"), F.inline(bounds)).select(
        *on, "_t", F.lit(0).alias("_side"), *[F.lit(0).cast(points.schema[n].dataType).alias(n) for n in parts], F.lit(0).cast("long").alias("_one"), "_cycle", "_sign"
    )
    totals = {f"_r{n}": n for n in [*parts, "_one"]}
    run = running_sums(points.unionByName(marks, allowMissingColumns=True), ["_t", "_side"], totals, by=on).filter("_side = 0")
    signed = {n: F.when(F.col("_sign") < 0, -F.col(f"_r{n}")).otherwise(F.col(f"_r{n}")) for n in [*parts, "_one"]}  # a product would lose digits
    out = run.groupBy("_cycle").agg(*[F.sum(c).alias(n) for n, c in signed.items()])
    total = {o: F.col(f"_whole_{o}").cast("double") + F.col(f"_rest_{o}").cast("double") if f"_rest_{o}" in parts else F.col(f"_whole_{o}") for o in sums}
    return out.select("_cycle.*", F.col("_one").alias(count), *[c.alias(o) for o, c in total.items()])


def lateral_top(df: DataFrame, other: DataFrame, on: str, key: str, order: Sequence[Column], n: int = 1) -> DataFrame:
    """Top ``n`` right rows per left row; the ranking filter runs before the shuffle."""
    from tidemark.operators.windows import top_n_per_group

    top = top_n_per_group(other, [key], order, n)
    return df.join(top, F.col(on) == F.col(key), "inner")


def join_or(a: DataFrame, b: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """``a.x = b.x OR a.y = b.y`` as two equi joins; the second skips pairs of the first."""
    one = a.join(b, F.col(first[0]) == F.col(first[1]))
    again = F.coalesce(F.col(first[0]) == F.col(first[1]), F.lit(False))
    two = a.join(b, (F.col(second[0]) == F.col(second[1])) & ~again)
    return one.unionByName(two)


def agg_then_join(parts: Sequence[DataFrame], key: str, how: str = "full") -> DataFrame:
    """Join facts of different grain only after each is aggregated to ``key``."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, how)
    return out


def join_key_profile(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Rows, distinct, NULLs and hottest key per side, plus the inner-join row count."""

    def counts(df, key):
        return df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def side(df, name):
        n, known = F.col("n"), F.col("k").isNotNull()
        return df.agg(
            F.lit(name).alias("side"),
            F.sum("n").alias("n_rows"),
            F.count("k").alias("n_keys"),
            F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("n_null"),
            F.max(F.when(known, n)).alias("max_per_key"),
        )

    ca, cb = counts(a, a_key), counts(b, b_key)
    both = ca.join(cb.withColumnsRenamed({"k": "k2", "n": "n2"}), F.col("k") == F.col("k2"))
    expected = both.agg(F.coalesce(F.sum(F.col("n") * F.col("n2")), F.lit(0)).alias("x")).scalar()
    return side(ca, "a").unionByName(side(cb, "b")).withColumn("join_rows", expected)


def assert_no_fanout(before: DataFrame, after: DataFrame) -> DataFrame:
    """Raise when a join multiplied or lost rows; returns ``after``.

    Equal counts don't prove it, as lost and doubled rows cancel out: the sum of a hash of
    each row's columns of ``before`` has to agree as well.
    """
    shared = [c for c in before.columns if c in after.columns and not isinstance(before.schema[c].dataType, (T.MapType, T.VariantType))]
    print_of = F.sum(F.xxhash64(*shared).cast("decimal(38,0)")) if shared else F.lit(None)
    (n0, h0), (n1, h1) = (df.agg(F.count(F.lit(1)), print_of).first() for df in (before, after))
    if n0 != n1:
        raise ValueError(f"join changed the row count from {n0} to {n1}")
    if h0 != h1:
        raise ValueError(f"join lost some rows and multiplied others; the count is still {n0}")
    return after


def relationship(fact: DataFrame, fk: str, dim: DataFrame, pk: str, name: str) -> DataFrame:
    """Cardinality class and referential-integrity share of one fact-dimension key."""
    f = fact.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("nf"))
    d = dim.filter(F.col(pk).isNotNull()).groupBy(F.col(pk).alias("k")).agg(F.count(F.lit(1)).alias("nd"))
    m = f.join(d, "k", "full").agg(
        F.max("nf").alias("mf"),
        F.max("nd").alias("md"),
        F.sum("nf").alias("rows_keyed"),
        F.sum(F.when(F.col("nd").isNull(), F.col("nf")).otherwise(0)).alias("rows_orphan"),
        F.count(F.when(F.col("nf").isNull(), 1)).alias("members_unused"),
    )
    left = F.when(F.col("mf") > 1, "N").otherwise("1")
    right = F.when(F.col("md") > 1, "N").otherwise("1")
    share = F.round(100.0 * (F.col("rows_keyed") - F.col("rows_orphan")) / F.col("rows_keyed"), 4)
    return m.select(
        F.lit(name).alias("relationship"),
        F.concat_ws(":", left, right).alias("cardinality"),
        "rows_keyed",
        "rows_orphan",
        "members_unused",
        share.alias("ri_pct"),
    )


def relationship_matrix(links: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    out = None
    for name, fact, fk, dim, pk in links:
        one = relationship(fact, fk, dim, pk, name)
        out = one if out is None else out.unionByName(one)
    return out


def map_ids(df: DataFrame, mapping: DataFrame, on: str, source: str, target: str) -> DataFrame:
    """Attach mapped ids and flag rows that have none."""
    lookup = mapping.select(F.col(source).alias("_src"), F.col(target).alias(target))
    out = df.join(lookup, F.col(on) == F.col("_src"), "left").drop("_src")
    return out.withColumn("is_mapped", F.col(target).isNotNull())
