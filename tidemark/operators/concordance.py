"""Kendall's tau-b: a distributed count of inversions.

Equal (x, y) are counted first. In the order by (x, y) a pair is discordant if the
order by (y, x) turns it round, so ties need no case of their own. The points are cut
into blocks of y and then into ranges of x:

    discordant = inversions inside ranges + inside blocks - inside cells (range, block)
               + those between points that differ in both, which only depend on the cells' counts

Ranges and blocks are counted by one task each, in a sort of their own size; the cells are points with weights
again and are counted in the same way, until they fit into one task. Nothing is paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.distributions import two_sided_normal
from tidemark.session import settle, shuffle_width

ONE_TASK = 1 << 20  # points that one task counts at once


def inversions(first: np.ndarray, second: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] * w[j] over pairs with first[i] < first[j] and second[i] > second[j].

    Points are put in order of (first, second); a rank by (second, first) is then read bit by
    bit: of two points that agree in the higher bits, a one before a zero is an inversion.
    """
    if len(w) < 2:
        return 0
    total = int(w.sum(dtype=object)) if len(w) < 1000 else sum(int(part.sum()) for part in np.array_split(w, 1000))
    kind = np.int64 if total < 1 << 31 else object  # beyond that, products leave 64 bits
    order = np.lexsort((second, first))
    first, second, w = first[order], second[order], w[order].astype(kind)
    rank = np.empty(len(w), np.int64)
    rank[np.lexsort((first, second))] = np.arange(len(w))
    found = 0
    for bit in range(int(len(w) - 1).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        ones = np.concatenate((np.zeros(1, kind), np.cumsum(w * one)))
        head = np.flatnonzero(np.diff(rank >> (bit + 1), prepend=-1))
        before = ones[:-1] - np.repeat(ones[head], np.diff(np.append(head, len(w))))
        found += int((before * w * (1 - one)).sum())
        keep = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[keep], w[keep]
    return found


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (zip(*parts) if parts else [[]] * len(names))]


COUNTED = "x double, y double, w long, block int, found decimal(38,0)"


def _inside(points: DataFrame, by: tuple[str, str], cells: bool) -> DataFrame:
    """The points dealt into ranges of ``by`` with their range in ``block``, and a row per range with the inversions inside.

    With ``cells``, the points come with blocks already, get summed up to a row per (range, block)
    as (x = range, y = block, w), and the inversions inside such cells are taken off.
    """
    n = shuffle_width(points.sparkSession, points)
    dealt = points.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id())
    names = ["x", "y", "w", "_range"] + ["block"] * cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, w, number, *block = _columns(batches, names)
        if not len(w):
            return
        first, second = (y, x) if by[0] == "y" else (x, y)
        found = inversions(first, second, w)
        if cells:
            for part in np.split(np.argsort(block[0], kind="stable"), np.flatnonzero(np.diff(np.sort(block[0]))) + 1):
                found -= inversions(first[part], second[part], w[part])
            blocks, inverse = np.unique(block[0], return_inverse=True)
            sums = np.zeros(len(blocks), np.int64)
            np.add.at(sums, inverse, w)
            x, y, w, number = np.full(len(blocks), number[0], float), blocks.astype(float), sums, np.full(len(blocks), number[0])
        arrays = [pa.array(x), pa.array(y), pa.array(w), pa.array(number.astype(np.int32)), pa.nulls(len(w), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", "w", "block", "found"])
        one = [pa.nulls(1, a.type) for a in arrays[:4]] + [pa.array([found], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(one, names=["x", "y", "w", "block", "found"])

    return settle(dealt.mapInArrow(count, COUNTED), "inversions")


def _total(counted: DataFrame) -> int:
    return int(counted.agg(F.sum("found")).first()[0] or 0)


def discordant(points: DataFrame) -> int:
    """Weighted pairs of points (x, y, w) with x and y in opposite order; ``points`` should be a written table with distinct (x, y)."""
    if points.count() <= ONE_TASK:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, w = _columns(batches, ["x", "y", "w"])
            yield pa.RecordBatch.from_arrays([pa.array([inversions(x, y, w)], pa.decimal128(38, 0))], names=["found"])

        return _total(points.coalesce(1).mapInArrow(whole, "found decimal(38,0)"))
    blocks = _inside(points, ("y", "x"), cells=False)
    ranges = _inside(blocks.filter("w IS NOT NULL").drop("found"), ("x", "y"), cells=True)
    return _total(blocks) + _total(ranges) + discordant(ranges.filter("w IS NOT NULL").select("x", "y", "w"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau_b, n, concordant and discordant pairs, and the normal test with tie terms (z, p_value) of two columns.

    Rows with a NULL in either are left out; tau_b is NULL if a column has one value only or there are no two rows.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    points = settle(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")), "points")

    def ties(*by: str) -> tuple[int, int, int, int]:
        t = F.col("t").cast("decimal(12,0)")
        sums = [F.sum(F.col("t").cast("decimal(38,0)")), F.sum(t * (t - 1)), F.sum((t * (t - 1)).cast("decimal(25,0)") * (t - 2)), F.sum((t * (t - 1)).cast("decimal(25,0)") * (2 * t + 5))]
        return tuple(int(v or 0) for v in points.groupBy(*by).agg(F.sum("w").alias("t")).agg(*sums).first())

    (n, x2, x3, x5), (_, y2, y3, y5), (_, both, _, _) = ties("x"), ties("y"), ties("x", "y")
    pairs = n * (n - 1) // 2
    against = discordant(points)
    agree = pairs - x2 // 2 - y2 // 2 + both // 2 - against
    free = (pairs - x2 // 2) * (pairs - y2 // 2)
    tau = (agree - against) / math.sqrt(free) if free > 0 else None
    var = (n * (n - 1) * (2 * n + 5) - x5 - y5) / 18
    var += x2 * y2 / (2 * n * (n - 1)) if n > 1 else 0
    var += x3 * y3 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
    z = (agree - against) / math.sqrt(var) if tau is not None and var > 0 else None
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in ("tau_b", "z") else T.DecimalType(38, 0)) for c in ("tau_b", "n", "concordant", "discordant", "z")])
    row = df.sparkSession.createDataFrame([(tau, *[Decimal(v) for v in (n, agree, against)], z)], schema)
    return row.withColumn("n", F.col("n").cast("long")).withColumn("p_value", F.when(F.col("z").isNotNull(), two_sided_normal(F.col("z"))))
