"""Dyadic cover: pairs of points and intervals against brute force, and sums with all their digits."""

import datetime as dt
import decimal
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators import joins as jn


@pytest.mark.parametrize("reach", [1, 5, 70, 5000, 10**12, 2**58])
def test_pairs_are_found_once(spark, reach):
    rng = random.Random(reach)
    points = [(rng.choice([0, 0, 0, 1, None]), rng.randint(-reach, reach), i) for i in range(300)] + [(0, None, 900)]
    spans = []
    for i in range(200):
        a = rng.randint(-reach, reach)
        spans.append((rng.choice([0, 0, 0, 1, None]), a, a + rng.choice([0, 1, rng.randint(0, reach), -3, rng.randint(0, max(1, reach // 1000))]), i))
    spans += [(0, None, 5, 900), (0, 1, None, 901), (0, -reach, reach + 1, 902), (1, spans[0][1], spans[0][1] + 1, 903)]
    p, s = spark.createDataFrame(points, "pk int, at long, pid int"), spark.createDataFrame(spans, "ik int, a long, b long, iid int")
    got = Counter((r["pid"], r["iid"]) for r in iv.contained(p, s, {"pk": "ik"}, "at", "a", "b").collect())
    want = Counter((i, j) for k, t, i in points for q, a, b, j in spans if None not in (k, t, a, b) and k == q and a <= t < b)
    assert got == want and sum(want.values()) > 50


def test_unfolded_rows_are_not_broadcast(spark):
    """The planner sizes unfolded intervals by the rows they came from, which is far too little for a broadcast."""
    p = spark.range(400).select((F.col("id") % 7).alias("pk"), (F.col("id") * 37 % 1000).alias("at"), F.col("id").alias("pid"))
    s = spark.range(60).select((F.col("id") % 7).alias("ik"), (F.col("id") * 11).alias("a"), (F.col("id") * 11 + 300).alias("b"), F.col("id").alias("iid"))
    out = iv.contained(p, s, {"pk": "ik"}, "at", "a", "b")
    got = Counter((r["pid"], r["iid"]) for r in out.collect())
    want = Counter((i, j) for i in range(400) for j in range(60) if i % 7 == j % 7 and j * 11 <= i * 37 % 1000 < j * 11 + 300)
    assert got == want and sum(want.values()) > 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_levels_are_those_of_the_cells(spark):
    rng = random.Random(5)
    spans = [(a, a + n) for a, n in ((rng.randrange(-(2**50), 2**50), rng.choice([0, 1, 2, 15, 16, 17, 255, 256, 2**20, rng.randrange(1, 2**45)])) for _ in range(300))]
    spans += [(16 * k, 16 * k + 16 * n) for k in range(4) for n in (1, 2, 16)] + [(None, 5), (5, None), (9, 3)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "id int, a long, b long")
    each = df.withColumn("c", F.explode(iv.cover(F.col("a"), F.col("b")))).select("id", "c._level").distinct()
    assert iv.levels_used(df, F.col("a"), F.col("b")) == sorted({r["_level"] for r in each.collect()})
    for i in range(0, len(spans), 23):
        assert iv.levels_used(df.filter(f"id = {i}"), F.col("a"), F.col("b")) == sorted(r["_level"] for r in each.filter(f"id = {i}").collect())


def test_cover_is_small_and_tight(spark):
    rng = random.Random(2)
    rows = [(a, a + n) for a, n in ((rng.randrange(-(2**50), 2**50), rng.choice([1, 2, 63, 64, 65, 2**20 + 1, rng.randrange(1, 2**45)])) for _ in range(500))]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", iv.cover(F.col("a"), F.col("b")).alias("c"))
    for a, b, cells in df.collect():
        ends = sorted((c << level, (c + 1) << level) for level, c in cells)
        assert 1 <= len(cells) <= 35 and ends[0][0] <= a and ends[-1][1] >= b
        assert all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
        assert ends[-1][1] - ends[0][0] <= 1.5 * (b - a) + 2


def test_one_key_with_100_000_versions(spark):
    """A range join would compare 100,000 versions with 50,000 facts, five billion times."""
    start = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_003)
    end = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") + 1) * 1_000_003)
    dim = spark.range(100_000).select(
        F.lit("hot").alias("k"), start.alias("row_effective_from"), F.when(F.col("id") < 99_999, end).alias("row_effective_to"), F.col("id").alias("version")
    )
    at = 1_700_000_000_000_000 - 5_000_000 + F.pmod(F.xxhash64("id"), F.lit(100_010 * 1_000_003))
    fact = spark.range(50_000).select(F.lit("hot").alias("k"), "id", at.alias("us"), F.timestamp_micros(at).alias("at"))
    out = jn.join_scd2(fact, dim, "k", "at").withColumn("want", F.floor((F.col("us") - 1_700_000_000_000_000) / 1_000_003))
    want = F.when(F.col("want") >= 0, F.least("want", F.lit(99_999)))
    row = out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count(F.when(~F.col("version").eqNullSafe(want), 1)).alias("wrong")).first()
    assert (row["n"], row["ids"], row["wrong"]) == (50_000, 50_000, 0)


def test_overlapping_versions_give_a_row_each(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    dim = spark.createDataFrame([(1, t(1), t(9), "a"), (1, t(3), None, "b"), (2, t(1), t(1), "never")], "k int, row_effective_from timestamp_ntz, row_effective_to timestamp_ntz, v string")
    fact = spark.createDataFrame([(1, t(2)), (1, t(5)), (1, t(9)), (2, t(1)), (None, t(1)), (1, None)], "k int, at timestamp_ntz")
    got = Counter((r["k"], r["at"].day if r["at"] else None, r["v"]) for r in jn.join_scd2(fact, dim, "k", "at").collect())
    assert got == Counter([(1, 2, "a"), (1, 5, "a"), (1, 5, "b"), (1, 9, "b"), (2, 1, None), (None, 1, None), (1, None, None)])
    assert jn.join_scd2(fact, dim, "k", "at", how="inner").count() == 4
    assert jn.join_scd2(fact, dim.limit(0), "k", "at").count() == 6 and jn.join_scd2(fact.limit(0), dim, "k", "at").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_facts_are_not_broadcast(spark, how):
    """Facts meet their versions by row number; the files of the facts say too little about their size in memory."""
    dim = spark.sql("SELECT 1L AS k, TIMESTAMP_NTZ '2024-01-02' AS row_effective_from, CAST(NULL AS TIMESTAMP_NTZ) AS row_effective_to, 'v' AS v")
    fact = spark.range(20).selectExpr("id", "id % 2 AS k", "TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 1) * (id % 3) AS at")
    out = jn.join_scd2(fact, dim, "k", "at", how=how)
    live = {i for i in range(20) if i % 2 and i % 3}
    assert {(r["id"], r["v"]) for r in out.collect()} == {(i, "v" if i in live else None) for i in (range(20) if how == "left" else live)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_interval_sums_keep_all_digits(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    cycles = spark.createDataFrame([(1, "a", t(2), t(5)), (2, "a", t(1), t(9)), (3, "b", t(1), t(2)), (4, "a", t(3), t(3))], "id int, k string, s timestamp_ntz, e timestamp_ntz")
    D = decimal.Decimal
    rows = [("a", t(2), 1.234e-7, D("0.0000000001"), 2**60), ("a", t(4), 1e27, D("9999999999.9999999999"), 2**60), ("a", t(6), -1e27, None, None), ("a", t(7), None, D("-1.5"), 3)]
    points = spark.createDataFrame(rows, "k string, t timestamp_ntz, d double, x decimal(20,10), n long")
    out = jn.interval_sums(cycles, points, ["id"], ["k"], "s", "e", "t", {"d": "d", "x": "x", "n": "n"})
    got = {r["id"]: (r["n_readings"], r["d"], r["x"], r["n"]) for r in out.collect()}
    assert got[1] == (2, 1e27, D("10000000000"), 2**61)
    assert got[2][:1] + got[2][2:] == (4, D("9999999998.5"), 2**61 + 3) and got[2][1] == pytest.approx(1.234e-7, rel=1e-12)
    assert got[3] == got[4] == (0, 0.0, D("0"), 0)
    assert out.schema["d"].dataType.simpleString() == "double" and out.schema["x"].dataType.simpleString().endswith(",10)")
