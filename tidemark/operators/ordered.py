"""Order-dependent work without single-task windows.

Ranks, running sums, exact quantiles and neighbour rows all need a global (or
per-key) order. A plain window would push one whole key - or the whole table -
through one task. Here the rows are dealt into ranges of (key, order, hash of the row),
so ties are split too; each range is windowed on its own and a small per-range table
carries totals or edge rows across the cuts. The dealt rows are written once and read
twice: the input is evaluated once, and both readings see the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.session import settle, shuffle_width

BUCKET, PART, TIE = "_bucket", "_part", "_tie"


def _cut_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], buckets: int | None) -> DataFrame:
    """Rows with ``_part``, key columns and range number as one struct, and ``_tie``, which ends the order.

    Struct equality treats NULL fields as equal, so one plain equi key serves the
    window, the per-range aggregate and the join back.
    """
    n = buckets or shuffle_width(df.sparkSession, df)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = df.withColumn(TIE, F.xxhash64(*plain)).repartitionByRange(n, *by, *order, TIE)
    cut = settle(dealt.withColumn(BUCKET, F.spark_partition_id()), "ranges")
    return cut.withColumn(PART, F.struct(*by, BUCKET)).drop(BUCKET)


def _key_window(by: Sequence[str]):
    """Ranges of a key in order (a small table: one row per key and range)."""
    return W.partitionBy(*[F.col(f"{PART}.{k}") for k in by]).orderBy(F.col(f"{PART}.{BUCKET}"))


def _earlier(by: Sequence[str]):
    return _key_window(by).rowsBetween(W.unboundedPreceding, -1)


def _attach(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Join the per-range table back; the rows keep their partitioning."""
    return rows.join(side, PART, "left").drop(PART, TIE)


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Cumulative sums over rows in ``order``; ``totals`` adds whole-key sums.

    ``sums`` and ``totals`` map an output name to an input column.
    """
    totals = dict(totals or {})
    cut = _cut_rows(df, by, order, buckets)
    within = W.partitionBy(PART).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, 0)
    rows = cut.select("*", *[F.sum(c).over(within).alias(o) for o, c in sums.items()])
    per_range = cut.groupBy(PART).agg(
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()],
    )
    whole = W.partitionBy(*[F.col(f"{PART}.{k}") for k in by])
    carried = per_range.select(
        PART,
        *[F.sum(f"_s_{o}").over(_earlier(by)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(o) for o in totals],
    )
    out = _attach(rows, carried)
    both = {}
    for o in sums:
        kind = out.schema[o].dataType
        room = f"decimal(37,{kind.scale})" if isinstance(kind, T.DecimalType) and kind.precision == 38 and kind.scale < 38 else kind
        own, before = F.col(o).cast(room), F.col(f"_o_{o}").cast(room)  # a sum of two full decimals would lose a digit behind the point
        both[o] = F.coalesce(own + F.coalesce(before, F.lit(0).cast(room)), before).cast(kind)
    return out.withColumns(both).drop(*[f"_o_{o}" for o in sums])


def running_min(
    df: DataFrame, order: Sequence[str], col: str, out: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Smallest value up to and including each row, in order."""
    cut = _cut_rows(df, by, order, buckets)
    within = W.partitionBy(PART).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, 0)
    rows = cut.withColumn(out, F.min(col).over(within))
    carried = cut.groupBy(PART).agg(F.min(col).alias("_m")).select(PART, F.min("_m").over(_earlier(by)).alias("_o"))
    return _attach(rows, carried).withColumn(out, F.least(out, "_o")).drop("_o")


def neighbour(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, str],
    step: int = -1,
    buckets: int | None = None,
) -> DataFrame:
    """Value of the previous (``step=-1``) or next (``step=1``) row in order."""
    if step not in (-1, 1):
        raise ValueError("step must be -1 or 1")
    cut = _cut_rows(df, by, order, buckets)
    within = W.partitionBy(PART).orderBy(*order, TIE)
    shift = F.lag if step < 0 else F.lead
    edge = F.max_by if step < 0 else F.min_by
    rows = cut.select(
        "*",
        shift(F.lit(1)).over(within).isNull().alias("_edge"),
        *[shift(F.col(c)).over(within).alias(o) for o, c in cols.items()],
    )
    tail = cut.groupBy(PART).agg(
        edge(F.struct(*[F.col(c).alias(o) for o, c in cols.items()]), F.struct(*order, TIE)).alias("_t")
    )
    carried = tail.select(PART, shift(F.col("_t")).over(_key_window(by)).alias("_c"))
    out = _attach(rows, carried)
    out = out.withColumns({o: F.when(F.col("_edge"), F.col(f"_c.{o}")).otherwise(F.col(o)) for o in cols})
    return out.drop("_edge", "_c")


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, str],
    buckets: int | None = None,
) -> DataFrame:
    """Last non-NULL value up to and including each row, in order."""
    cut = _cut_rows(df, by, order, buckets)
    within = W.partitionBy(PART).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, 0)
    rows = cut.select("*", *[F.last(c, ignorenulls=True).over(within).alias(o) for o, c in cols.items()])
    key = F.struct(*order, TIE)
    tail = cut.groupBy(PART).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_t_{o}") for o, c in cols.items()]
    )
    carried = tail.select(
        PART, *[F.last(f"_t_{o}", ignorenulls=True).over(_earlier(by)).alias(f"_c_{o}") for o in cols]
    )
    out = _attach(rows, carried)
    out = out.withColumns({o: F.coalesce(F.col(o), F.col(f"_c_{o}")) for o in cols})
    return out.drop(*[f"_c_{o}" for o in cols])


def column_lookup(stats: DataFrame, fields: Sequence[str], key: str = "column") -> Column:
    """Per-column figures as a map for use beside raw rows, without shuffling those.

    Its size is the number of profiled columns, which the schema bounds.
    """
    entry = F.struct(F.col(key), F.struct(*fields))
    return stats.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def beside(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group figures next to each row: NULL-safe join on the keys, or scalars when there are none."""
    fields = [c for c in stats.columns if c not in by]
    if not by:
        one = stats.select(F.struct(*fields)).scalar()
        return rows.withColumn("_b", one).select(*rows.columns, *[F.col(f"_b.{c}").alias(c) for c in fields])
    side = stats.withColumnsRenamed({k: f"_b_{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return rows.join(side, cond, "left").drop(*[f"_b_{k}" for k in by])


def value_counts_table(
    df: DataFrame, value: str, groups: Mapping[str, Column] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct value with a count per named condition."""
    groups = groups or {"n": F.lit(True)}
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.count(F.when(cond, 1)).alias(name) for name, cond in groups.items()])
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct values with count ``n``, total ``n_total`` and tie-averaged rank ``avg_rank``."""
    if weight is None:
        counts = value_counts_table(df, value, by=by)
    else:
        counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("n"))
    ranked = running_sums(counts, [value], {"cum": "n"}, by=by, totals={"n_total": "n"})
    return ranked.withColumn("avg_rank", F.col("cum") - F.col("n") + (F.col("n") + 1) / F.lit(2.0))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value double) long form of numeric columns."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "value")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    weight: str | None = None,
    few_keys: bool = True,
) -> DataFrame:
    """Linear-interpolated quantiles per key as doubles, one output column per name.

    Two scans and no shuffle of the values: see ``bracketed_counts``. With a ``weight``, or
    for so many keys that a sketch per key does not pay (``few_keys=False``), distinct
    values are counted and dealt into ranges instead. No group has to fit anywhere, and the
    result is exact either way.
    """
    names = {name: float(p) for name, p in probs.items()}
    if weight is not None or not few_keys:
        return _interpolated(average_ranks(df, value, by, weight), value, names, by).drop("_missed")
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    spread = BRACKET
    while True:
        counts, bound = bracketed_counts(rows, list(names.values()), by, spread)
        found = settle(_interpolated(_ranked(counts, by, bound), "_x", names, by, F.col("_gap")), "quantiles")
        if found.filter("_missed").isEmpty():
            return found.drop("_missed")
        spread *= 16  # from one half on, the bracket is the whole range


SKETCH_ACCURACY = 10_000
BRACKET = 4 / SKETCH_ACCURACY  # on either side: the sketch's error, two ranks of the smallest sketched group, and as much again
WHOLE_GROUP = 2 * SKETCH_ACCURACY  # groups of so many rows are not bracketed
WINDOW_ROWS = 1 << 21


def bracketed_counts(rows: DataFrame, probs: Sequence[float], by: Sequence[str], spread: float) -> tuple[DataFrame, int]:
    """(by..., _x, _gap, n) and about how many rows that has: counts of the values that could be a wanted quantile.

    A mergeable sketch per key gives a lower and an upper value around each probability.
    The second scan counts the values inside some bracket one by one, and
    all between two brackets together: such a count stands at the upper value of the
    bracket below (NULL below the first), with ``_gap`` set. Both collapse on the map side.
    """
    levels = sorted({min(1.0, max(0.0, p + side * spread)) for p in probs for side in (-1, 1)})
    at = {level: i for i, level in enumerate(levels)}
    sketch = F.percentile_approx("_x", F.array(*[F.lit(x) for x in levels]), F.lit(SKETCH_ACCURACY)).alias("_q")
    sketches = rows.groupBy(*by).agg(sketch, F.count(F.lit(1)).alias("_n"))
    if by:
        sketches = settle(sketches, "sketches")
        beside_rows = beside(rows, sketches, by)
        total = sketches.agg(F.sum(_bracketed(F.col("_n"), len(probs), spread))).first()[0] or 0
    else:
        one = sketches.select("_q", "_n", _bracketed(F.col("_n"), len(probs), spread).alias("held")).first()  # two numbers for each probability
        q = F.array(*[F.lit(x) for x in one["_q"] or [0.0] * len(levels)])
        beside_rows = rows.select("*", q.alias("_q"), F.lit(one["_n"]).alias("_n"))
        total = one["held"] or 0
    x, cuts = F.col("_x"), sorted(set(probs))
    edge = {(p, side): F.col("_q")[at[min(1.0, max(0.0, p + side * spread))]] for p in cuts for side in (-1, 1)}

    def place(first: int, last: int) -> Column:
        """Value and gap of a row whose value lies above the brackets before ``first``; halves the brackets per step."""
        if first == last:
            p = cuts[first]
            below = edge[cuts[first - 1], 1] if first else F.lit(None).cast("double")
            inside = F.lit(True) if p - spread <= 0 else x >= edge[p, -1]
            return F.when(inside, F.struct(x.alias("_x"), F.lit(False).alias("_gap"))).otherwise(F.struct(below.alias("_x"), F.lit(True).alias("_gap")))
        middle = (first + last) // 2
        return F.when(x <= edge[cuts[middle], 1], place(first, middle)).otherwise(place(middle + 1, last))

    top = cuts[-1]
    above = F.lit(False) if top + spread >= 1 else x > edge[top, 1]
    placed = F.when(F.col("_n") <= WHOLE_GROUP, F.struct(x.alias("_x"), F.lit(False).alias("_gap")))
    placed = placed.when(above, F.struct(edge[top, 1].alias("_x"), F.lit(True).alias("_gap"))).otherwise(place(0, len(cuts) - 1))
    marked = beside_rows.select(*by, placed.alias("_p")).select(*by, "_p._x", "_p._gap")
    return marked.groupBy(*by, "_x", "_gap").agg(F.count(F.lit(1)).alias("n")), int(total)


def _bracketed(n: Column, probs: int, spread: float) -> Column:
    return F.when(n <= WHOLE_GROUP, n).otherwise(F.least(n, F.ceil(n * (2 * spread * probs)) + probs + 1))


def _ranked(counts: DataFrame, by: Sequence[str], bound: int) -> DataFrame:
    """Running and whole sums of the counts: a plain window where all brackets together are small."""
    if bound > WINDOW_ROWS:
        return running_sums(counts, ["_x", "_gap"], {"cum": "n"}, by=by, totals={"n_total": "n"})
    keyed = W.partitionBy(*by) if by else W.partitionBy()
    return counts.select("*", F.sum("n").over(keyed.orderBy("_x", "_gap")).alias("cum"), F.sum("n").over(keyed).alias("n_total"))


def _interpolated(ranked: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str], gap: Column | None = None) -> DataFrame:
    """Quantiles from running counts (cum, n, n_total): the two order statistics around each position.

    ``_missed`` says that one of them stands in a gap.
    """
    n, cum = F.col("n_total"), F.col("cum")
    gap = F.lit(False) if gap is None else gap
    picks, missed = [], F.lit(False)
    for name, p in probs.items():
        pos = (n - 1) * F.lit(p)
        for edge, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (cum - F.col("n") <= rank) & (rank < cum)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{edge}_{name}"))
            missed = missed | (here & gap)
    found = ranked.groupBy(*by).agg(F.max("n_total").alias("_n"), F.coalesce(F.max(missed), F.lit(False)).alias("_missed"), *picks)
    out = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos))).alias(name))  # also for infinities
    return found.select(*by, *out, "_missed")
