"""Profiling: columns, keys, gaps, duplicates, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.functions.columns import TIMESTAMP_FORMATS, hash_diff, micros, parse_ts, period, safe_div
from tidemark.operators.ordered import column_lookup, exact_quantiles, neighbour, unpivot_numeric
from tidemark.session import settle

# Profile thresholds.
COMPLETENESS_MIN = 0.7
PK_RATIO_MIN = 0.999
NUMERIC_SHARE_MIN = 0.95
DATETIME_SHARE_MIN = 0.5
IQR_MULTIPLIER = 1.5
DATETIME_NAME_HINTS = ("date", "time", "dt")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _as_text(df: DataFrame, name: str, blank_is_null: bool) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.trim(c) != "", c) if blank_is_null else c
    if isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _long_text(df: DataFrame, cols: Sequence[str], blank_is_null: bool) -> DataFrame:
    wide = df.select(*[_as_text(df, c, blank_is_null).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "value")


def column_value_counts(df: DataFrame, cols: Sequence[str] | None = None, blank_is_null: bool = True) -> DataFrame:
    """(column, value, n) for all columns with one shuffle, combined on the map side."""
    return _long_text(df, cols or df.columns, blank_is_null).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def profile(
    df: DataFrame, cols: Sequence[str] | None = None, blank_is_null: bool = True, approx: bool = False
) -> DataFrame:
    """Type, rows, NULLs, completeness, distinct values and unique ratio per column.

    ``approx`` estimates distinct counts with sketches in one pass without a shuffle
    of values; the default is exact.
    """
    cols = list(cols or df.columns)
    kinds = F.create_map(*[F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())])
    if approx:
        stats = _long_text(df, cols, blank_is_null).groupBy("column").agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count("value").alias("non_null"),
            F.approx_count_distinct("value", 0.01).alias("unique_count"),
        )
    else:
        stats = column_value_counts(df, cols, blank_is_null).groupBy("column").agg(
            F.sum("n").alias("total_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.count("value").alias("unique_count"),
        )
    return stats.select(
        "column",
        kinds[F.col("column")].alias("dtype"),
        "total_rows",
        "non_null",
        (F.col("total_rows") - F.col("non_null")).alias("nulls"),
        F.round(safe_div("non_null", "total_rows"), 6).alias("completeness"),
        "unique_count",
        F.round(safe_div("unique_count", "non_null", 0), 6).alias("unique_ratio"),
    )


def check_completeness(prof: DataFrame, threshold: float = COMPLETENESS_MIN) -> DataFrame:
    return prof.filter(F.col("completeness") < threshold).select(
        F.lit("warn").alias("severity"),
        F.lit("completeness_below_threshold").alias("rule"),
        "column",
        F.concat(F.lit("completeness "), F.format_number("completeness", 4)).alias("message"),
    )


def pk_candidates(prof: DataFrame) -> DataFrame:
    keep = (F.col("unique_ratio") >= PK_RATIO_MIN) & (F.col("total_rows") > 1) & (F.col("nulls") == 0)
    return prof.filter(keep).select(
        F.lit("info").alias("severity"),
        F.lit("pk_candidate").alias("rule"),
        "column",
        F.concat(F.lit("unique ratio "), F.format_number("unique_ratio", 4)).alias("message"),
    )


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample sd, min, exact quartiles, max: one row per column."""
    rows = unpivot_numeric(df, list(cols or numeric_columns(df)))
    base = rows.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return base.join(exact_quantiles(rows, "value", QUARTILES, by=["column"]), "column", "left")


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = IQR_MULTIPLIER) -> DataFrame:
    """Fences and strict outlier count per column."""
    rows = unpivot_numeric(df, list(cols or numeric_columns(df)))
    q = exact_quantiles(rows, "value", QUARTILES, by=["column"])
    iqr = F.col("q75") - F.col("q25")
    fences = q.select("column", (F.col("q25") - k * iqr).alias("lower"), (F.col("q75") + k * iqr).alias("upper"))
    marked = rows.withColumn("_f", column_lookup(fences, ["lower", "upper"])[F.col("column")])
    out = (F.col("value") < F.col("_f.lower")) | (F.col("value") > F.col("_f.upper"))
    return (
        marked.groupBy("column")
        .agg(F.first("_f").alias("_f"), F.count(F.when(out, 1)).alias("n_outliers"))
        .select("column", "_f.lower", "_f.upper", "n_outliers")
    )


def ts_gaps(df: DataFrame, col: str, hours: float = 24, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive timestamps further apart than ``hours``; no single-task sort."""
    stamps = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).alias("gap_start")).distinct()
    nxt = neighbour(stamps, by, ["gap_start"], {"gap_end": "gap_start"}, step=1)
    gap = (micros("gap_end") - micros("gap_start")) / F.lit(3.6e9)
    return nxt.withColumn("gap_hours", gap).filter(F.col("gap_hours") > hours)


def duplicate_rows(df: DataFrame) -> DataFrame:
    n = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def check_pk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    key = ",".join(cols)
    if missing:
        return df.sparkSession.createDataFrame(
            [(key, ",".join(missing), None, False)],
            "key string, missing string, n_duplicates long, is_unique boolean",
        )
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")).select(
        F.lit(key).alias("key"),
        F.lit(None).cast("string").alias("missing"),
        "n_duplicates",
        (F.col("n_duplicates") == 0).alias("is_unique"),
    )


def check_range(df: DataFrame, specs: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows below / above the stated bounds; text that is no number is ignored."""
    aggs = []
    for c, (lo, hi) in specs.items():
        v = F.col(c).try_cast("double")
        below = F.lit(0).cast("long") if lo is None else F.count(F.when(v < lo, 1))
        above = F.lit(0).cast("long") if hi is None else F.count(F.when(v > hi, 1))
        aggs.append(F.struct(F.lit(c).alias("column"), below.alias("n_below"), above.alias("n_above")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def _told(severity: str, rule: str, message: Column):
    return F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("column"), message.alias("message")


def range_issues(df: DataFrame, ranges: Mapping) -> DataFrame:
    """Values outside stated bounds; missing columns and bounds that are no numbers are errors."""
    spark, good, wrong = df.sparkSession, {}, []
    for c, bounds in ranges.items():
        try:
            lo, hi = (None if v is None else float(v) for v in bounds)
        except (TypeError, ValueError):
            wrong.append(("error", "range_config_error", c, f"bounds {bounds!r} are not two numbers"))
            continue
        if c not in df.columns:
            wrong.append(("error", "range_column_missing", c, "no such column"))
        else:
            good[c] = (lo, hi)
    out = spark.createDataFrame(wrong, "severity string, rule string, column string, message string")
    if good:
        hit = check_range(df, good).filter("n_below + n_above > 0")
        text = F.concat(F.col("n_below").cast("string"), F.lit(" below, "), F.col("n_above").cast("string"), F.lit(" above"))
        out = out.unionByName(hit.select(*_told("warn", "range_violation", text)))
    return out


def key_issues(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """A stated key that lacks columns, repeats or is unique."""
    state = check_pk(df, key)
    rule = F.when(F.col("missing").isNotNull(), "pk_missing_columns").when(F.col("is_unique"), "pk_unique").otherwise("pk_not_unique")
    severity = F.when(F.col("missing").isNull() & F.col("is_unique"), "info").otherwise("error")
    text = F.coalesce(F.concat(F.lit("no column "), "missing"), F.concat(F.col("n_duplicates").cast("string"), F.lit(" duplicates")))
    return state.select(severity.alias("severity"), rule.alias("rule"), F.col("key").alias("column"), text.alias("message"))


def issues(
    df: DataFrame,
    ranges: Mapping | None = None,
    threshold: float = COMPLETENESS_MIN,
    key: Sequence[str] | None = None,
    gap_hours: float = 0,
    k: float = IQR_MULTIPLIER,
) -> DataFrame:
    """Issue list of a profile run: severity, rule, column and message.

    Completeness, key candidates, numeric outliers, gaps in time columns (if
    ``gap_hours`` is over 0), duplicate rows, the stated key and the stated ranges.
    """
    prof = settle(profile(df), "profile")  # one row per column, read twice
    parts = [check_completeness(prof, threshold), pk_candidates(prof)]
    if numeric_columns(df):
        far = iqr_outliers(df, k=k).filter("n_outliers > 0")
        parts.append(far.select(*_told("warn", "numeric_outliers", F.concat(F.col("n_outliers").cast("string"), F.lit(" outside the fences")))))
    if gap_hours > 0:
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                n = ts_gaps(df, f.name, gap_hours).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").withColumn("column", F.lit(f.name))
                parts.append(n.select(*_told("warn", "datetime_gap", F.concat(F.col("n").cast("string"), F.lit(f" gaps over {gap_hours} h")))))
    again = duplicate_rows(df).filter("n_duplicates > 0").withColumn("column", F.lit(None).cast("string"))
    parts.append(again.select(*_told("warn", "duplicate_rows", F.concat(F.col("n_duplicates").cast("string"), F.lit(" duplicate rows")))))
    if key:
        parts.append(key_issues(df, key))
    if ranges:
        parts.append(range_issues(df, ranges))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gate(found: DataFrame, strict: bool = False) -> DataFrame:
    """Issue counts per severity and the verdict; ``strict`` also fails on warnings."""
    bad = ["error", "warn"] if strict else ["error"]
    return found.agg(
        *[F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}") for s in ("error", "warn", "info")],
        (F.count(F.when(F.col("severity").isin(*bad), 1)) == 0).alias("passed"),
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Likely type of text columns: numeric share, then date-like names that parse."""
    aggs = []
    for c in string_columns(df):
        v = F.when(F.trim(c) != "", F.trim(c))
        hinted = any(h in c.lower() for h in DATETIME_NAME_HINTS) or c.lower().endswith("ts")
        n = F.count(v)
        as_ts = F.count(parse_ts(v, TIMESTAMP_FORMATS)) if hinted else F.lit(0).cast("long")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                n.alias("n_values"),
                F.count(v.try_cast("double")).alias("n_numeric"),
                as_ts.alias("n_datetime"),
            )
        )
    rows = df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))
    numeric = (F.col("n_numeric") > 0) & (F.col("n_numeric") >= F.greatest(F.lit(1.0), F.col("n_values") * NUMERIC_SHARE_MIN))
    dated = F.col("n_datetime") > F.greatest(F.lit(1.0), F.col("n_values") * DATETIME_SHARE_MIN)
    kind = F.when(numeric, "numeric").when(dated, "datetime").otherwise("text")
    return rows.withColumn("inferred", kind)


def table_summary(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).withColumn("n_columns", F.lit(len(df.columns)))


def volume_by_period(df: DataFrame, ts: str, unit: str, spike: float = 10) -> DataFrame:
    """Rows per calendar period on a full spine, with gap and spike flags."""
    counts = df.groupBy(period(ts, unit).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("period")
    )
    full = spine.join(counts, "period", "left").fillna(0, ["n"])
    mid = counts.agg(F.median("n").alias("m")).scalar()  # counts: one row per calendar period
    flag = F.when(F.col("n") == 0, "gap").when(F.col("n") > spike * mid, "spike").otherwise("ok")
    return full.withColumn("flag", flag)


def missing_periods(df: DataFrame, ts: str, unit: str) -> DataFrame:
    return volume_by_period(df, ts, unit).filter("n = 0").select("period")


def quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[int] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    return exact_quantiles(unpivot_numeric(df, cols), "value", {f"p{p}": p / 100 for p in ps}, by=["column"])


def sentinel_scan(df: DataFrame, sentinels: Sequence) -> DataFrame:
    """Occurrences of placeholder values per column and value, in one pass."""
    words = [str(s) for s in sentinels]
    rows = _long_text(df, df.columns, blank_is_null=False).filter(F.trim("value").isin(*words))
    return rows.groupBy("column", F.trim("value").alias("sentinel")).agg(F.count(F.lit(1)).alias("n"))


def _prints(cols: Sequence[str]) -> list[Column]:
    """128 bits of the values of some columns, as two numbers. NULLs count by their place only if there is one column."""
    return [F.xxhash64(*cols), F.xxhash64(*cols, F.lit(7))]


def grain_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per non-key column: in how many duplicate key groups its values differ.

    Keys are counted first; only rows of keys that occur twice are looked at again, and their
    values are compared as 128-bit hashes. NULL is a value like any other.
    """
    others = [c for c in df.columns if c not in keys]
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    twice = settle(twice.withColumnsRenamed({k: f"_k_{k}" for k in keys}), "twice")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = df.join(twice, same, "left_semi")
    hashed = rows.select(*keys, *[h.alias(f"_h{i}_{j}") for i, c in enumerate(others) for j, h in enumerate(_prints([c]))])
    differs = [(F.min(f"_h{i}_0") != F.max(f"_h{i}_0")) | (F.min(f"_h{i}_1") != F.max(f"_h{i}_1")) for i in range(len(others))]
    groups = hashed.groupBy(*keys).agg(*[d.cast("long").alias(f"_d{i}") for i, d in enumerate(differs)])
    structs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(f"_d{i}"), F.lit(0)).alias("groups_differing")) for i, c in enumerate(others)]
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.array(*structs).alias("r")).select("duplicate_groups", F.inline("r"))


def classify_duplicates(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Cause of every duplicate key: exact copies, re-processed rows or a wrong grain."""
    attrs = [c for c in df.columns if c not in keys and c != ts]
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(hash_diff(attrs)) == F.max(hash_diff(attrs))).alias("same"),
        (F.min(ts) == F.max(ts)).alias("same_ts"),
    )
    cause = (
        F.when(F.col("same") & F.col("same_ts"), "exact_copy")
        .when(F.col("same"), "re_processed")
        .otherwise("grain_mismatch")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        g.filter("n > 1")
        .groupBy(cause.alias("cause"))
        .agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_excess"))
        .withColumn("excess_rate", safe_div("n_excess", total))
    )


SKETCH_ERROR = 0.02


def find_keys(df: DataFrame, max_cols: int = 2) -> DataFrame:
    """Single columns, then pairs, that identify every row.

    One pass keeps a mergeable distinct sketch for every column and every pair. Only those
    whose estimate comes within eight standard errors of the row count are verified, by
    counting 128-bit hashes; columns with NULLs and pairs with a key in them are left out.
    """
    cols = df.columns
    sets = [(c,) for c in cols] + (list(combinations(cols, 2)) if max_cols > 1 else [])
    sketches = [F.approx_count_distinct(F.xxhash64(*own), SKETCH_ERROR).alias(f"_s{i}") for i, own in enumerate(sets)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(cols)], *sketches).first()  # a number per column and pair
    usable = {c for i, c in enumerate(cols) if one[f"_c{i}"] == one["_n"]}
    near = [own for i, own in enumerate(sets) if usable >= set(own) and one[f"_s{i}"] >= one["_n"] * (1 - 8 * SKETCH_ERROR)]
    single = _identifying(df, [own for own in near if len(own) == 1])
    taken = {c for own in single for c in own}
    pairs = _identifying(df, [own for own in near if len(own) == 2 and not taken & set(own)])
    return df.sparkSession.createDataFrame([(",".join(own), len(own)) for own in single + pairs], "key string, n_columns int")


def _identifying(df: DataFrame, sets: list[tuple]) -> list[tuple]:
    """Which of the column sets have no two equal rows."""
    if not sets:
        return []
    entries = F.array(*[F.struct(F.lit(i).alias("i"), *[h.alias(f"h{j}") for j, h in enumerate(_prints(own))]) for i, own in enumerate(sets)])
    doubled = df.select(F.inline(entries)).groupBy("i", "h0", "h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    failed = {r["i"] for r in doubled.select("i").distinct().collect()}  # a number per set at most
    return [own for i, own in enumerate(sets) if i not in failed]


def null_report(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    share = F.round(1 - F.col("completeness"), 6)
    return profile(df).select("column", "nulls", share.alias("null_share"), (share > threshold).alias("is_risk"))


def freshness(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Lag between an injected clock and the newest row."""
    newest = df.agg(F.max(ts).alias("newest"))
    lag = (micros(F.lit(as_of).cast("timestamp_ntz")) - micros("newest")) / F.lit(3.6e9)
    return newest.withColumn("lag_hours", lag)


def profile_categorical(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Distinct count, top ``k`` share and tail share per column."""
    counts = column_value_counts(df, cols, blank_is_null=False).filter("value IS NOT NULL")
    w = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    head = top.groupBy("column").agg(F.sum("n").alias("_top"), F.min_by("value", "_rn").alias("top_value"))
    whole = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values"))
    out = whole.join(head, "column")
    return out.select(
        "column", "n_distinct", "n_values", "top_value",
        safe_div("_top", "n_values").alias("top_share"),
        safe_div(F.col("n_values") - F.col("_top"), "n_values").alias("tail_share"),
    )


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the exact extremes; the maximum is in the last bin."""
    v = F.col(col).cast("double")
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    number = F.coalesce(F.try_divide(v - ends["lo"], width), F.lit(0.0))
    bin_no = F.least(F.floor(number), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bin_start", ends["lo"] + F.col("bin") * width)
