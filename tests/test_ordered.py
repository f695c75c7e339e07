"""Order-based helpers against brute force, with a hot key, NULL keys and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as od


def frame(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n)).astype(object)
    key[rng.random(n) < 0.05] = None
    return pd.DataFrame({"id": np.arange(n), "k": key, "v": rng.integers(0, 300, n).astype(float), "w": rng.integers(1, 5, n)})


SCHEMA = "id long, k string, v double, w long"


def brute(pdf, fn):
    return pd.concat([fn(g.sort_values(["v", "id"])) for _, g in pdf.groupby("k", dropna=False)]).sort_values("id")


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_running_sums_and_totals(spark, buckets):
    pdf = frame()
    got = od.running_sums(spark.createDataFrame(pdf, SCHEMA), ["v", "id"], {"c": "w"}, by=["k"], totals={"t": "w"}, buckets=buckets)
    got = got.toPandas().sort_values("id")
    want = brute(pdf, lambda g: g.assign(c=g.w.cumsum(), t=g.w.sum()))
    assert got.c.tolist() == want.c.tolist() and got.t.tolist() == want.t.tolist()


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour(spark, step):
    pdf = frame(2)
    got = od.neighbour(spark.createDataFrame(pdf, SCHEMA), ["k"], ["v", "id"], {"o": "id"}, step).toPandas().sort_values("id")
    want = brute(pdf, lambda g: g.assign(o=g.id.shift(-step)))
    assert got.o.fillna(-1).tolist() == want.o.fillna(-1).tolist()


def test_carry_forward(spark):
    pdf = frame(3)
    pdf["s"] = pdf.v.where(pdf.w == 1)
    got = od.carry_forward(spark.createDataFrame(pdf, SCHEMA + ", s double").replace(float("nan"), None), ["k"], ["v", "id"], {"o": "s"})
    got = got.toPandas().sort_values("id")
    want = brute(pdf, lambda g: g.assign(o=g.s.ffill()))
    assert got.o.fillna(-1).tolist() == want.o.fillna(-1).tolist()


def test_running_min(spark):
    pdf = frame(4)
    got = od.running_min(spark.createDataFrame(pdf, SCHEMA), ["v", "id"], "w", "m", by=["k"]).toPandas().sort_values("id")
    assert got.m.tolist() == brute(pdf, lambda g: g.assign(m=g.w.cummin())).m.tolist()


def test_exact_quantiles_match_numpy(spark):
    pdf = frame(5)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.913, "e": 1.0}
    got = od.exact_quantiles(spark.createDataFrame(pdf, SCHEMA), "v", probs, by=["k"]).toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.k.isna()] if row.k is None or row.k != row.k else pdf[pdf.k == row.k]
        assert np.allclose([row[p] for p in probs], np.percentile(part.v, [100 * p for p in probs.values()]))


def test_weighted_quantiles(spark):
    pdf = frame(6)
    got = od.exact_quantiles(spark.createDataFrame(pdf, SCHEMA), "v", {"m": 0.5}, weight="w").first()["m"]
    assert got == np.median(np.repeat(pdf.v, pdf.w))


def test_text_order(spark):
    words = [f"Brand#{i:04d}" for i in range(500)] + ["Brand#zz", "Brand#é"]
    df = spark.createDataFrame([(w, 1) for w in words], "s string, one int")
    got = od.running_sums(df, ["s"], {"r": "one"}).toPandas()
    order = sorted(words, key=lambda w: w.encode())
    assert dict(zip(got.s, got.r, strict=True)) == {w: i + 1 for i, w in enumerate(order)}


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert od.running_sums(empty, ["v"], {"c": "w"}, by=["k"]).count() == 0
    assert od.exact_quantiles(empty, "v", {"m": 0.5}, by=["k"]).count() == 0
    one = spark.createDataFrame([(1, None, 7.0, 2)], SCHEMA)
    assert od.exact_quantiles(one, "v", {"m": 0.5}).first()["m"] == 7.0
    assert od.neighbour(one, ["k"], ["v"], {"o": "id"}).first()["o"] is None


@pytest.mark.parametrize("kind", ["ties", "strings"])
def test_ranges_are_even(spark, kind):
    """Neither 80 % ties nor one outlying string puts more than twice the mean into a range."""
    n = 40_000
    if kind == "ties":
        df = spark.range(n).select("id", F.when(F.col("id") % 5 < 4, 1).otherwise(F.col("id")).alias("v"))
    else:
        df = spark.range(n).select("id", F.concat(F.lit("https://example.org/a/long/prefix/"), F.col("id").cast("string")).alias("v"))
        df = df.unionByName(spark.createDataFrame([(-1, "A"), (-2, "z")], "id long, v string"))
    cut = od._cut_rows(df, [], ["v"], 20)
    sizes = [r.n for r in cut.groupBy(f"{od.PART}.{od.BUCKET}").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * sum(sizes) / 20
    run = od.running_sums(df.withColumn("one", F.lit(1)), ["v"], {"r": "one"}, buckets=20)
    assert run.select("r").distinct().count() == df.count() == run.agg(F.max("r")).first()[0]


def bracket_frame(seed, n=6000):
    """Values with a tie that holds a third of the rows, NULLs, outliers, a hot key and a NULL key."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.33, 7.25, rng.normal(0, 50, n))
    v[:3] = [1e300, -1e300, 1e299]
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n)).astype(object)
    key[rng.random(n) < 0.05] = None
    return pd.DataFrame({"k": key, "v": v})


PROBS = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "m": 0.5, "again": 0.5, "close": 0.501, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("whole, accuracy, window", [(20_000, 10_000, 1 << 21), (50, 200, 1 << 21), (50, 200, 10), (0, 40, 1 << 21)])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_bracketed_quantiles_are_exact(spark, monkeypatch, whole, accuracy, window, by):
    """Also where groups are bracketed by a coarse sketch, and where the brackets are too narrow at first."""
    monkeypatch.setattr(od, "WHOLE_GROUP", whole)
    monkeypatch.setattr(od, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(od, "BRACKET", 4 / accuracy if whole else 1e-9)
    monkeypatch.setattr(od, "WINDOW_ROWS", window)
    pdf = bracket_frame(whole)
    df = spark.createDataFrame(pdf, "k string, v double").unionByName(spark.createDataFrame([("a", None)] * 9, "k string, v double"))
    got = od.exact_quantiles(df, "v", PROBS, by=by).collect()
    assert len(got) == (5 if by else 1)
    for row in got:
        part = pdf if not by else pdf[pdf.k.isna()] if row["k"] is None else pdf[pdf.k == row["k"]]
        want = np.percentile(np.sort(part.v), [100 * p for p in PROBS.values()])
        assert [row[p] for p in PROBS] == pytest.approx(want.tolist(), rel=1e-9)


def test_many_probabilities_and_no_rows(spark):
    pdf = bracket_frame(9)
    probs = {f"p{i}": i / 100 for i in range(1, 100)}
    got = od.exact_quantiles(spark.createDataFrame(pdf, "k string, v double"), "v", probs).first()
    assert list(got) == pytest.approx(np.percentile(pdf.v, range(1, 100)).tolist(), rel=1e-9)
    far = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "v double")
    assert list(od.exact_quantiles(far, "v", {"a": 0.0, "m": 0.5, "z": 1.0}).first()) == [float("-inf"), 1.0, float("inf")]
    none = spark.createDataFrame([(None,)], "v double")
    assert od.exact_quantiles(none, "v", {"m": 0.5}).first()["m"] is None
    assert od.exact_quantiles(spark.createDataFrame([], SCHEMA), "v", {"m": 0.5}).first()["m"] is None


def test_bracketing_moves_few_values(spark):
    """Of 300,000 distinct values, the shuffle gets those around the quantiles."""
    rows = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("_x"))
    counts, bound = od.bracketed_counts(rows, [0.25, 0.5, 0.75], [], od.BRACKET)
    assert counts.count() < 1000 and bound < 1000
