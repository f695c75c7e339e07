"""Column helpers: predicates, text, dates, keys, safe arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Timestamp layouts that text columns may use.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
)

NULL_MARKER = "∅"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact cents, so that sums do not depend on row order."""
    return col_of(c).cast("decimal(18,2)")


def money_sum(c: Column | str) -> Column:
    return F.sum(money(c)).cast("double")


# --- predicates -----------------------------------------------------------


def date_range(c: Column | str, start: str, end: str) -> Column:
    """Half-open range on the bare column, so that it reaches the file scan."""
    c = col_of(c)
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def bucketize(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label by ascending lower edges: below edges[0] takes labels[0]."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    c = col_of(c)
    out = F.when(c < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1], strict=True):
        out = out.when(c < edge, label)
    return out.when(c.isNotNull(), labels[-1])


def nullify(c: Column | str, sentinels: Sequence) -> Column:
    c = col_of(c)
    return F.when(~c.isin(*sentinels), c)


# --- text -------------------------------------------------------------------


def concat_strict(*cols: Column | str) -> Column:
    """NULL if any part is NULL."""
    return F.concat(*cols)


def concat_skip(*cols: Column | str, sep: str = "") -> Column:
    """NULL parts are skipped."""
    return F.concat_ws(sep, *cols)


def norm_text(c: Column | str) -> Column:
    """Lower case, outer blanks removed, inner blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(col_of(c), r"\s+", " ")))


def matches(c: Column | str, pattern: str) -> Column:
    return col_of(c).rlike(pattern)


# --- dates ------------------------------------------------------------------


def period(c: Column | str, unit: str) -> Column:
    """Start date of the day, week (Monday), month, quarter or year; start time of the hour, minute or second."""
    c = col_of(c)
    if unit in ("hour", "minute", "second"):
        return F.date_trunc(unit, c)
    return c.cast("date") if unit == "day" else F.date_trunc(unit, c).cast("date")


def add_period(c: Column | str, n: int, unit: str) -> Column:
    c = col_of(c).cast("date")
    if unit in ("day", "week"):
        return F.date_add(c, n * (7 if unit == "week" else 1))
    return F.add_months(c, n * {"month": 1, "quarter": 3, "year": 12}[unit])


def month_end(c: Column | str) -> Column:
    return F.last_day(col_of(c))


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col_of(end), col_of(start))


def local_period(ts: Column | str, zone: str, unit: str) -> Column:
    """UTC wall clock to ``zone``, then truncate."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), col_of(ts).cast("timestamp_ntz"))
    return period(local, unit)


def micros(c: Column | str) -> Column:
    return F.unix_micros(col_of(c).cast("timestamp"))


def hours_between(a: Column | str, b: Column | str) -> Column:
    return (micros(b) - micros(a)) / F.lit(3.6e9)


def parse_ts(c: Column | str, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    c = col_of(c)
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def date_key(c: Column | str) -> Column:
    c = col_of(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def fiscal(c: Column | str, start_month: int = 4) -> dict[str, Column]:
    """Fiscal year (named by its end), quarter and ``FYyyyy-Pmm`` period."""
    shifted = F.add_months(col_of(c).cast("date"), (13 - start_month) % 12)
    year = F.year(shifted)
    return {
        "fiscal_year": year,
        "fiscal_quarter": F.quarter(shifted),
        "fiscal_period": F.concat(
            F.lit("FY"), year.cast("string"), F.lit("-P"), F.lpad(F.month(shifted).cast("string"), 2, "0")
        ),
    }


# --- casts and arithmetic ---------------------------------------------------


def to_num(c: Column | str, kind: str = "double") -> Column:
    return col_of(c).try_cast(kind)


def to_date(c: Column | str) -> Column:
    return col_of(c).try_cast("date")


def safe_div(n: Column | str, d: Column | str, alt: float | None = None) -> Column:
    """NULL (or ``alt``) when the divisor is 0 or NULL."""
    ratio = F.try_divide(col_of(n).cast("double"), col_of(d).cast("double"))
    return ratio if alt is None else F.coalesce(ratio, F.lit(float(alt)))


# --- keys -------------------------------------------------------------------


def hash_key(cols: Sequence[Column | str]) -> Column:
    """Deterministic text key; NULL has its own marker, so it never equals ''."""
    parts = [F.coalesce(col_of(c).cast("string"), F.lit(NULL_MARKER)) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_diff(cols: Sequence[Column | str]) -> Column:
    """Cheap null-safe change fingerprint (64-bit, JVM only)."""
    parts = [F.coalesce(col_of(c).cast("string"), F.lit(NULL_MARKER)) for c in cols]
    return F.xxhash64(*parts)


def json_get(c: Column | str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(col_of(c), path).try_cast(kind)


def all_of(rules: Mapping[str, Column] | Sequence[Column]) -> Column:
    parts = list(rules.values()) if isinstance(rules, Mapping) else list(rules)
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out
