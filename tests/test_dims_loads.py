"""Dimensions, facts and loads: integrity, reruns, injected faults."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import business as bz
from tidemark.operators import dims as dm
from tidemark.operators import joins as jn
from tidemark.operators import loads as ld
from tidemark.operators import measures as ms
from tidemark.operators import reconcile as rc

D2 = "k int, v string, row_effective_from timestamp_ntz, row_effective_to timestamp_ntz, is_current boolean"


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture()
def dim2(spark):
    rows = [(1, "a", day(1), None, True), (2, "b", day(1), day(5), False), (2, "c", day(5), None, True), (3, None, day(1), None, True)]
    return spark.createDataFrame(rows, D2)


def test_scd2_changes_and_rerun(spark, dim2):
    src = spark.createDataFrame([(1, "a"), (2, "d"), (3, "x"), (4, "n")], "k int, v string")
    once = dm.scd2(dim2, src, "k", ["v"], "2024-01-10 00:00:00")
    got = {(x.k, x.v, x.row_effective_to, x.is_current) for x in once.collect()}
    assert got == {
        (1, "a", None, True), (2, "b", day(5), False), (2, "c", day(10), False), (2, "d", None, True),
        (3, None, day(10), False), (3, "x", None, True), (4, "n", None, True),
    }
    assert dm.check_scd2(once, "k").count() == 0
    twice = dm.scd2(once, src, "k", ["v"], "2024-01-11 00:00:00")
    assert rc.table_fingerprint(once).first() == rc.table_fingerprint(twice).first()
    closed = dm.scd2(once, src.filter("k <> 1"), "k", ["v"], "2024-01-12 00:00:00", close_missing=True)
    assert closed.filter("k = 1 AND is_current").count() == 0


def test_scd2_join_is_half_open(spark, dim2):
    fact = spark.createDataFrame([(2, day(4)), (2, day(5)), (2, day(6)), (9, day(5))], "k int, at timestamp_ntz")
    out = jn.join_scd2(fact, dim2, "k", "at").collect()
    assert sorted((x.at.day, x.v) for x in out if x.v) == [(4, "b"), (5, "c"), (6, "c")] and len(out) == 4


def test_dense_scd2_join_equals_range_join(spark, dim2):
    rows = [(k, day(d)) for k in (1, 2, 3, 9) for d in (1, 4, 5, 6)] + [(None, day(3))]
    fact = spark.createDataFrame(rows, "k int, at timestamp_ntz")
    gap = dim2.filter("NOT (k = 2 AND v = 'c')")  # key 2 has no version after day 5
    for dim in (dim2, gap):
        for how in ("left", "inner"):
            a = jn.join_scd2(fact, dim, "k", "at", how=how).select("k", "at", "v", "is_current")
            b = jn.join_scd2(fact, dim, "k", "at", how=how, dense=True).select("k", "at", "v", "is_current")
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_interval_sums_equal_pairs_for_overlapping_intervals(spark):
    import random

    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    c = [(i, 0 if rnd.random() < 0.6 else rnd.randint(1, 4), t0 + dt.timedelta(hours=rnd.randint(0, 90))) for i in range(120)]
    c = [(i, k, a, a + dt.timedelta(hours=rnd.randint(0, 40))) for i, k, a in c]
    r = [(0 if rnd.random() < 0.6 else rnd.randint(1, 4), t0 + dt.timedelta(hours=rnd.randint(0, 120)), round(rnd.random() * 9, 2)) for _ in range(300)]
    cycles = spark.createDataFrame(c, "id int, k int, a timestamp_ntz, b timestamp_ntz")
    points = spark.createDataFrame(r, "k int, t timestamp_ntz, v double")
    got = {x.id: (x.n_readings, float(x.s)) for x in jn.interval_sums(cycles, points, ["id"], ["k"], "a", "b", "t", {"s": "v"}).collect()}
    for i, k, a, b in c:
        inside = [v for kk, t, v in r if kk == k and a <= t < b]
        assert got[i][0] == len(inside) and got[i][1] == pytest.approx(sum(inside))


def test_history_collapses_repeats(spark):
    log = [(1, "a", day(1)), (1, "a", day(2)), (1, None, day(3)), (1, None, day(4)), (1, "a", day(5))]
    out = dm.scd2_from_history(spark.createDataFrame(log, "k int, v string, ts timestamp_ntz"), "k", ["v"], "ts")
    got = [(x.v, x.row_effective_from, x.row_effective_to) for x in out.orderBy(dm.FROM).collect()]
    assert got == [("a", day(1), day(3)), (None, day(3), day(5)), ("a", day(5), None)]
    assert dm.check_scd2(out, "k").count() == 0


def test_broken_history_is_found(spark, dim2):
    bad = dim2.withColumn(dm.TO, F.when(F.col("v") == "b", F.lit(day(7)).cast("timestamp_ntz")).otherwise(F.col(dm.TO)))
    assert [x.k for x in dm.check_scd2(bad, "k").collect()] == [2]


def test_surrogate_keys_are_dense_and_stable(spark):
    new = spark.createDataFrame([(w,) for w in "abcdefgh"], "bk string")
    first = dm.assign_keys(new, spark.createDataFrame([], "bk string, sk long"), ["bk"], "sk")
    known = spark.createDataFrame(first.collect(), "bk string, sk long")
    more = spark.createDataFrame([(w,) for w in "ghijk"], "bk string")
    second = {x.bk: x.sk for x in dm.assign_keys(more, known, ["bk"], "sk").collect()}
    assert sorted(second.values()) == list(range(1, 12))
    assert all(second[x.bk] == x.sk for x in known.collect())


def test_allocation_and_star_keep_totals(spark):
    fact = spark.createDataFrame([(1, 100.01), (2, 50.0)], "k int, amount double")
    bridge = spark.createDataFrame([(1, "a", 0.3333), (1, "b", 0.6667), (2, "a", 1.0)], "k int, rep string, w double")
    out = dm.allocate(fact, bridge, "k", "amount", "w")
    assert float(out.agg(F.sum("allocated")).first()[0]) == pytest.approx(150.01)
    star = jn.star_join(fact, {"k": (spark.createDataFrame([(1, 7)], "bk int, sk int"), "bk", "sk")})
    assert {(x.k, x.k_key) for x in star.collect()} == {(1, 7), (2, -1)}


def test_long_lookups_are_merged(spark, monkeypatch):
    """Files hold keys in far less than a broadcast takes on the driver, so rows decide."""
    fact, dim = spark.range(50).select((F.col("id") % 9).alias("k")), spark.range(7).select("id", (F.col("id") * 3).alias("sk"))
    for rows, kind in ((7, "BroadcastHashJoin"), (6, "SortMergeJoin")):
        monkeypatch.setattr(jn, "BROADCAST_ROWS", rows)
        star = jn.star_join(fact, {"k": (dim, "id", "sk")})
        assert {(x.k, x.k_key) for x in star.collect()} == {(k, k * 3 if k < 7 else -1) for k in range(9)}
        assert kind in star._jdf.queryExecution().executedPlan().toString()


def test_fact_writes_needed_columns_only(spark):
    from tidemark import session

    src = spark.range(40).selectExpr("id", "id % 5 AS k", "id % 3 AS d", "TIMESTAMP_NTZ '2024-01-02' AS at", "repeat('x', 100) AS wide", "CAST(id AS DOUBLE) AS v")
    vers = spark.sql("SELECT 2L AS bk, 'b' AS sk, TIMESTAMP_NTZ '2024-01-01' AS row_effective_from, CAST(NULL AS TIMESTAMP_NTZ) AS row_effective_to")
    n = len(session._settled)
    out = dm.build_fact(src, {"d": (spark.range(2).selectExpr("id", "id + 10 AS sk"), "id", "sk")}, {"k": (vers, "bk", "sk")}, "at", ["id"], {"twice": F.col("v") * 2})
    got = {x.id: (x.d_key, x.k_version_key, x.date_key, x.twice) for x in out.collect()}
    assert got == {i: (-1 if i % 3 == 2 else i % 3 + 10, "b" if i % 5 == 2 else "-1", 20240102, 2.0 * i) for i in range(40)}
    facts = next(p for p in session._settled[n:] if "/facts-" in p)
    assert sorted(spark.read.parquet(facts).columns) == ["_id", "_m_twice", "at", "d_key", "id", "k"]


def test_date_dimension_edges(spark):
    b = spark.sql("SELECT DATE '2023-12-31' AS a, DATE '2024-03-31' AS b")
    d = {x.date: x for x in dm.dim_date(b, "a", "b", 4, ["2024-01-01"], "2024-01-02").collect()}
    leap = d[dt.date(2024, 2, 29)]
    assert (leap.day_of_year, leap.fiscal_year, leap.fiscal_period) == (60, 2024, "FY2024-P11")
    assert d[dt.date(2023, 12, 31)].week_key == 202352 and d[dt.date(2024, 1, 1)].week_key == 202401
    assert not d[dt.date(2024, 1, 1)].is_working_day and d[dt.date(2024, 1, 1)].relative_days == -1
    assert len(d) == 92


def test_asof_join_matches_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 800, p=[0.6, 0.2, 0.2]), "t": base + pd.to_timedelta(rng.integers(0, 9999, 800), "s"), "id": range(800)})
    right = pd.DataFrame({"k": rng.choice(["hot", "a"], 300), "u": base + pd.to_timedelta(rng.permutation(9999)[:300], "s"), "v": range(300)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", tolerance=pd.Timedelta("10min"))
    got = jn.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["v"], "10 MINUTES").toPandas()
    a, b = want.sort_values("id").v.fillna(-1).tolist(), got.sort_values("id").v.fillna(-1).tolist()
    assert a == b


def test_interval_agg_keeps_empty_intervals(spark):
    c = spark.createDataFrame([(1, 1, day(1), day(3)), (2, 1, day(3), day(3)), (3, 2, day(1), day(2))], "id int, k int, a timestamp_ntz, b timestamp_ntz")
    r = spark.createDataFrame([(1, day(1), 1.0), (1, day(2), 2.0), (1, day(3), 4.0)], "k int, t timestamp_ntz, v double")
    out = jn.interval_agg(c, r, ["id"], ["k"], "a", "b", "t", {"s": F.sum("v"), "n": F.count("t")})
    assert {x.id: (x.s, x.n) for x in out.collect()} == {1: (3.0, 2), 2: (None, 0), 3: (None, 0)}


def test_or_join_matches_single_condition(spark):
    a = spark.createDataFrame([(1, 9), (2, 8), (None, 8), (3, None)], "x int, y int")
    b = spark.createDataFrame([(1, 9), (5, 8), (3, 3)], "p int, q int")
    want = a.join(b, (F.col("x") == F.col("p")) | (F.col("y") == F.col("q"))).collect()
    assert sorted(map(str, jn.join_or(a, b, ("x", "p"), ("y", "q")).collect())) == sorted(map(str, want))


def test_versions_survive_a_crash_before_the_switch(spark, folder):
    df = spark.range(5)
    ld.publish(df, folder, "v1", day(1))
    df.limit(2).write.parquet(f"{folder}/data/v2")  # crash: written, never switched
    assert ld.current(spark, folder).count() == 5
    ld.publish(df.limit(3), folder, "v3", day(2))
    assert ld.current(spark, folder).count() == 3
    ld.rollback(spark, folder, "v1", day(3))
    assert ld.current(spark, folder).count() == 5
    with pytest.raises(ValueError, match="never published"):
        ld.rollback(spark, folder, "v2", day(4))


def test_backfill_is_repeatable_and_local(spark, folder):
    rows = spark.range(300).select((F.col("id") % 3).alias("d"), F.col("id").alias("v"))
    path = f"{folder}/t"
    ld.overwrite_partitions(rows, path, "d")
    fix = lambda a, b: rows.withColumn("v", F.lit(0).cast("long"))
    for _ in range(2):
        ld.backfill(fix, path, "d", 1, 2)
    got = {x.d: (x.n, x.s) for x in spark.read.parquet(path).groupBy("d").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert got == {0: (100, 14850), 1: (100, 0), 2: (100, 15050)}


def test_upsert_and_sync(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert {tuple(x) for x in ld.upsert(t, s, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert {tuple(x) for x in ld.upsert(ld.upsert(t, s, ["k"]), s, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert {(x.k, x.is_deleted) for x in ld.sync(t, s, ["k"], "soft").collect()} == {(1, True), (2, False), (3, False)}
    assert {x.change for x in ld.detect_changes(t, s, ["k"], ["v"]).collect()} == {"delete", "update", "insert"}
    assert ld.incremental_slice(s, t.limit(0), "k", "1 DAY").count() == 2


def test_prior_period_on_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 28), 1.0), (dt.date(2024, 2, 29), 2.0), (dt.date(2025, 2, 28), 5.0)], "d date, v double")
    out = {x.d: x.prior for x in ms.vs_prior(df, [], "d", "v", "year").collect()}
    assert out == {dt.date(2024, 2, 28): None, dt.date(2024, 2, 29): None, dt.date(2025, 2, 28): 2.0}


def test_filter_modes():
    base = {"a": [1, 2], "b": [3]}
    assert ms.with_filters(base, {"a": [2, 9]}) == {"a": [2, 9], "b": [3]}
    assert ms.with_filters(base, {"a": [2, 9]}, "intersect") == {"a": [2], "b": [3]}


def test_market_basket_against_brute_force(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(7)
    sizes = np.where(np.arange(200) == 0, 12, rng.integers(1, 5, 200))  # one very large basket
    baskets = [sorted(rng.choice(list("abcdefghijkl"), s, replace=False)) for s in sizes]
    lines = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "o int, item string")
    want = {}
    for b in baskets:
        for p in itertools.combinations(b, 2):
            want[p] = want.get(p, 0) + 1
    got = {(x.item_a, x.item_b): x.n_baskets for x in bz.market_basket(lines, "o", "item", 0.05).collect()}
    assert got == {p: n for p, n in want.items() if n >= 10}


def test_ntile_matches_sql(spark):
    df = spark.range(23).select((F.col("id") % 3).alias("g"), F.col("id"))
    df.createOrReplaceTempView("nt")
    want = {x.id: x.t for x in spark.sql("SELECT id, ntile(5) OVER (PARTITION BY g ORDER BY id) AS t FROM nt").collect()}
    assert {x.id: x.t for x in bz.ntile_by_rank(df, ["g"], ["id"], 5, "t").collect()} == want


def test_cycles_need_an_end_after_the_start(spark):
    ev = [(1, 1, "e"), (1, 2, "s"), (1, 3, "s"), (1, 4, "e"), (1, 5, "e"), (1, 6, "s")]
    df = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, h), w) for k, h, w in ev], "k int, t timestamp_ntz, w string")
    out = bz.build_cycles(df, "k", "t", "w", "s", "e").orderBy("cycle_no").collect()
    assert [(x.cycle_no, x.started_at.hour, x.ended_at and x.ended_at.hour) for x in out] == [(1, 2, None), (2, 3, 4), (3, 6, None)]
