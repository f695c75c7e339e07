"""Running quantiles, fan-out by hash, quoted line breaks, and an entry without the optional subpackage."""

import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import joins as jn
from tidemark.sources.tables import read_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_earlier_quantiles_match_numpy(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(400)]
    got = dr.earlier_quantiles(spark.createDataFrame(rows, "k string, day int, v double"), ["k"], "day", "v", {"lo": 0.1, "hi": 0.9}).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [v for k, d, v in rows if k == r["k"] and None not in (d, v, r["day"]) and d < r["day"]]
        want = np.percentile(seen, [10, 90]).tolist() if seen else [None, None]
        assert [r["lo"], r["hi"]] == (pytest.approx(want) if seen else want)


def test_sorted_runs_are_linear_in_a_long_series():
    rng = random.Random(2)
    values = [rng.random() for _ in range(50_000)]
    runs, start = dr.SortedRuns(), time.perf_counter()
    for v in values:
        runs.quantile(0.1), runs.quantile(0.9)
        runs.add(v)
    assert time.perf_counter() - start < 30
    assert runs.quantile(0.37) == pytest.approx(np.quantile(values, 0.37)) and [x for r in runs.runs for x in r] == sorted(values)


def test_fanout_guard_sees_lost_and_doubled_rows(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert jn.assert_no_fanout(before, before.withColumn("new", F.lit(1)).orderBy(F.desc("k"))).count() == 3
    swapped = spark.createDataFrame([(1, "a"), (1, "a"), (3, None)], "k int, v string")
    with pytest.raises(ValueError, match="multiplied others"):
        jn.assert_no_fanout(before, swapped)
    with pytest.raises(ValueError, match="row count"):
        jn.assert_no_fanout(before, before.unionByName(before))


def test_a_quoted_line_break_is_one_record(spark, folder):
    with open(f"{folder}/t.csv", "w") as file:
        file.write('id,text\n1,"first\nsecond, ""quoted"""\n2,plain\n')
    rows = read_table(spark, f"{folder}/t.csv", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", 'first\nsecond, "quoted"'), ("2", "plain")]


@pytest.mark.parametrize("missing", ["tokenizers", "public_tokenizers", "tidemark.llm"])
def test_entry_survives_a_missing_package(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    n, has_op = done.stdout.split()[-2:]
    assert int(n) > 300 and has_op == "False"


def test_keys_are_found_and_grains_checked(spark):
    from tidemark.operators import profile as pf

    n = 5000
    df = spark.range(n).select(
        "id", (F.col("id") % 100).alias("a"), F.floor(F.col("id") / 100).alias("b"), F.when(F.col("id") != 7, F.col("id")).alias("holed"),
        F.when(F.col("id") == 1, 0).otherwise(F.col("id")).alias("almost"), F.lit("x").alias("flat"), F.struct((F.col("id") % 50).alias("s")).alias("c"),
    )
    assert {tuple(r) for r in pf.find_keys(df).collect()} == {("id", 1), ("a,b", 2), ("a,almost", 2), ("almost,c", 2)}
    assert pf.find_keys(df.drop("id"), 1).isEmpty()
    plan = pf.find_keys(df.drop("id"))._jdf.queryExecution().toString()
    assert "json" not in plan.lower()
    rows = [(1, "k", "a", None), (1, "k", "a", 2), (None, "k", "b", 5), (None, "k", "c", 5), (2, None, "d", 1), (3, "k", "e", None), (3, "k", "e", None)]
    got = pf.grain_check(spark.createDataFrame(rows, "p int, q string, v string, w int"), ["p", "q"]).collect()
    assert {(r["column"], r["duplicate_groups"], r["groups_differing"]) for r in got} == {("v", 3, 1), ("w", 3, 1)}
    unique = pf.grain_check(spark.createDataFrame(rows[:1], "p int, q string, v string, w int"), ["p", "q"]).collect()
    assert {(r["column"], r["duplicate_groups"], r["groups_differing"]) for r in unique} == {("v", 0, 0), ("w", 0, 0)}


def test_settled_tables_are_cleaned_up(spark):
    from tidemark import session

    kept = session.new_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    path = session.settle(spark.range(5), "gone").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(path) and session.clean_up(spark) >= 1
    assert not os.path.isdir(path) and spark.read.parquet(kept).count() == 3 and session.clean_up(spark) == 0
