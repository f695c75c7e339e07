"""Containment of points in intervals as an equi join: a dyadic cover of time.

Time is cut into aligned cells of 2^level microseconds, every fourth level. An interval
unfolds into few cells that cover it: the finest are a fourth to a sixty-fourth of its own
length, so it has at most 35. A point unfolds into the cells around it, one for each level
that any interval uses. A point and an interval meet in at most one cell, and the bounds are
compared there, so a pair is found once and only a part of the outermost cells is met in vain.
However many intervals and points a key has, and however they overlap, the work is
proportional to the rows and the pairs; a hot (key, cell) is one of many, and as an inner
equi join it is split by the planner on either side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

STEP = 4  # bits between levels


def _shift(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, F.lit(bits).cast("int") if isinstance(bits, int) else bits)


def _range(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _edges(start: Column, end: Column) -> tuple[Column, ...]:
    """Finest level of [start, end), its cells there from ``first`` to before ``last``, and the whole cells of the next level."""
    bits = F.length(F.bin(end - start))
    low = (F.greatest(F.lit(0), F.floor((bits - 3) / STEP)) * STEP).cast("int")
    first, last = _shift(start, low), _shift(end - 1, low) + 1
    return low, first, last, _shift(first + (2**STEP - 1), STEP), _shift(last, STEP)


def levels_used(intervals: DataFrame, start: Column, end: Column) -> list[int]:
    """Levels that the covers have cells of: from the bounds alone, nothing unfolds."""
    low, first, last, up_first, up_last = _edges(start, end)
    some, wide = start < end, up_first < up_last
    fine = ~wide | (first < up_first * 2**STEP) | (up_last * 2**STEP < last)
    found = intervals.agg(F.collect_set(F.when(some & fine, low)), F.collect_set(F.when(some & wide, low + STEP))).first()
    return sorted({*found[0], *found[1]})  # 17 numbers at most


def cover(start: Column, end: Column) -> Column:
    """Cells (level, cell) whose union is the least that covers [start, end) at the interval's own finest level.

    Empty for an empty interval or NULL bounds.
    """
    low, first, last, up_first, up_last = _edges(start, end)
    wide = up_first < up_last
    sides = F.concat(_range(first, up_first * 2**STEP - 1), _range(up_last * 2**STEP, last - 1))
    fine = F.when(wide, sides).otherwise(_range(first, last - 1))
    coarse = F.when(wide, _range(up_first, up_last - 1)).otherwise(F.array().cast("array<bigint>"))
    cells = F.concat(
        F.transform(fine, lambda c: F.struct(low.alias("_level"), c.alias("_cell"))),
        F.transform(coarse, lambda c: F.struct((low + STEP).alias("_level"), c.alias("_cell"))),
    )
    return F.when(start < end, cells)


def around(at: Column, levels: Sequence[int]) -> Column:
    """The cell of each level that a point lies in."""
    return F.array(*[F.struct(F.lit(level).alias("_level"), _shift(at, level).alias("_cell")) for level in levels])


def contained(points: DataFrame, intervals: DataFrame, on: Mapping[str, str], at: str, start: str, end: str) -> DataFrame:
    """All (point, interval) pairs with equal keys and start <= at < end, each once: the columns of both.

    ``on`` maps key columns of the points to those of the intervals; ``at``, ``start`` and
    ``end`` are columns of whole microseconds. Column names of both sides must differ. A NULL
    key, point or bound meets nothing.
    """
    spread = intervals.withColumn("_c", F.explode(cover(F.col(start), F.col(end)))).select(*intervals.columns, "_c.*")
    levels = levels_used(intervals, F.col(start), F.col(end))
    if not levels:
        return points.join(intervals, F.lit(False), "inner")
    held = points.filter(F.col(at).isNotNull()).withColumn("_p", F.explode(around(F.col(at), levels)))
    held = held.select(*points.columns, F.col("_p._level").alias("_at_level"), F.col("_p._cell").alias("_at_cell"))
    spread = spread.hint("merge")  # the planner takes unfolded rows for as few as they came from, and would broadcast them through the driver
    pairs = [*on.items(), ("_at_cell", "_cell"), ("_at_level", "_level")]  # the few levels come last: rows are sorted by the first that differs
    same = F.lit(True)
    for p, i in pairs:
        same = same & (F.col(p) == F.col(i))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return held.join(spread, same & inside).select(*points.columns, *intervals.columns)
