"""Kendall's tau against all pairs."""

import random

import numpy as np
import pytest

from tidemark.operators import concordance as cc


def plain(rows):
    known = [(x, y) for x, y in rows if x is not None and y is not None]
    agree = against = 0
    for i, (a, b) in enumerate(known):
        for c, d in known[:i]:
            s = (a - c) * (b - d)
            agree, against = agree + (s > 0), against + (s < 0)
    n = len(known)
    ties = lambda k: sum(known[i][k] == known[j][k] for i in range(n) for j in range(i))
    free = (n * (n - 1) // 2 - ties(0)) * (n * (n - 1) // 2 - ties(1))
    return n, agree, against, (agree - against) / free**0.5 if free else None


def test_inversions_match_all_pairs():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (2, 2), (50, 4), (300, 40)):
        x, y, w = rng.integers(0, top, n), rng.integers(0, top, n), rng.integers(1, 9, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert cc.inversions(x, y, w) == want
    assert cc.inversions(np.array([0, 1]), np.array([1, 0]), np.array([2**40, 2**41])) == 2**81


@pytest.mark.parametrize("one_task", [1 << 20, 100])
def test_kendall_matches_all_pairs(spark, monkeypatch, one_task):
    """Also where the points are cut into ranges, and their cells once more; a tie holds a third of the rows."""
    monkeypatch.setattr(cc, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    rows = [(None if rng.random() < 0.02 else rng.choice([1.0, rng.randrange(30), rng.random() * 30]), rng.choice([None, 2.0, rng.randrange(25), rng.random() * 25])) for _ in range(700)]
    rows = [(x, None if y is None else float(y) + (x or 0) / 9) for x, y in rows] + [(5.0, 5.0)] * 200
    rows = [(None if x is None else float(x), y) for x, y in rows]
    got = cc.kendall(spark.createDataFrame(rows, "x double, y double").repartition(5), "x", "y").first()
    n, agree, against, tau = plain(rows)
    assert (got["n"], int(got["concordant"]), int(got["discordant"])) == (n, agree, against)
    assert got["tau_b"] == pytest.approx(tau) and got["p_value"] < 0.05


def test_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "x double, y double")
    assert cc.kendall(df([]), "x", "y").first()["tau_b"] is None
    assert cc.kendall(df([(1.0, 2.0)]), "x", "y").first()["tau_b"] is None
    assert cc.kendall(df([(1.0, 2.0), (1.0, 3.0)]), "x", "y").first()["tau_b"] is None
    row = cc.kendall(df([(1.0, 2.0), (2.0, 1.0), (3.0, 0.0)]), "x", "y").first()
    assert row["tau_b"] == -1.0 and row["discordant"] == 3
