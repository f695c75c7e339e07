"""Runs of an upsert log, and keyed state with timers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import streams as ss

EVENTS = "id long, k long, t timestamp_ntz, w string"


def test_upsert_runs_stay_few_and_replays_are_harmless(spark, folder):
    """50 batches through the handler itself; some are replayed at once, as after a crash before the commit."""
    handlers = []
    real, ss_run = ss.run_batches, lambda df, handle, checkpoint: handlers.append(handle)
    ss.run_batches = ss_run
    try:
        ss.upsert_stream(None, f"{folder}/t", ["k"], ["t", "id"])
    finally:
        ss.run_batches = real
    (handle,) = handlers
    want, t0, most = {}, dt.datetime(2024, 1, 1), 0
    for b in range(50):  # as many as the highest level needs
        rows = [(b * 4 + i, (b * 7 + i * 3) % 23, t0 + dt.timedelta(minutes=b if (b + i) % 5 else -b), "x") for i in range(4)]
        for i, k, t, _ in rows:
            if k not in want or (t, i) > want[k]:
                want[k] = (t, i)
        batch = spark.createDataFrame(rows, EVENTS)
        for _ in range(2 if b in (3, 15, 31) else 1):
            handle(batch, b)
        most = max(most, len(ss._runs(spark, f"{folder}/t", b)))
    folders = [d for sub in ("log", "runs") for d in os.listdir(f"{folder}/t/{sub}") if not d.startswith(".")]
    assert most <= 9 and len(folders) < 12 and len(os.listdir(f"{folder}/t/manifest")) <= 3
    got = {r["k"]: (r["t"], r["id"]) for r in ss.read_upserted(spark, f"{folder}/t", ["k"], ["t", "id"]).collect()}
    assert got == want


def cycle_batches(spark, folder, seed=3):
    """Four files of events; within a file and across neighbouring ones the order is mixed by up to an hour."""
    import random

    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), rng.choice("se")) for i in range(240)]
    mixed = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(50)))
    for b in range(4):
        spark.createDataFrame(mixed[b * 60 : (b + 1) * 60], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return rows


@pytest.mark.parametrize("timeout", [None, 3.0])
def test_keyed_cycles_equal_the_batch_result(spark, folder, timeout):
    pytest.importorskip("google.protobuf")
    from tidemark.streaming import keyed

    rows = cycle_batches(spark, folder)
    stream = ss.read_events_stream(spark, f"{folder}/in", EVENTS, files_per_batch=1)
    before = spark.conf.get(keyed.STORE_KEY)
    with keyed.timed_state(spark):
        out = keyed.keyed_cycles(stream, "k", "t", "w", "s", "e", "id", "1 hour", timeout)
        got = {tuple(r) for r in ss.run_to_table(out, "keyed").collect()}
    assert spark.conf.get(keyed.STORE_KEY) == before
    mark = max(r[2] for r in rows) - dt.timedelta(hours=1)
    want = set()
    for k in range(4):
        opened = None
        for _, _, t, w in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], str(r[0]))):
            if opened and timeout and t - opened > dt.timedelta(hours=timeout):
                want.add((k, opened, None))
                opened = None
            if w == "s":
                opened = t
            elif opened:
                want.add((k, opened, t))
                opened = None
    want = {c for c in want if c[2] is None or c[2] < mark}
    closed = {c for c in got if c[2] is not None}
    if timeout is None:
        assert got == want and len(got) > 30
    else:  # a start is given up when its timer is due, which may be a batch later than its end
        assert all(c[2] is None or c[2] - c[1] <= dt.timedelta(days=1) for c in got) and len(closed) > 20


def test_the_watermark_is_that_of_all_events(spark, folder):
    """An event of another kind moves the watermark on, so a cycle that ended before it is due."""
    pytest.importorskip("google.protobuf")
    from tidemark.streaming import keyed

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 7, t0, "s"), (2, 7, t0 + dt.timedelta(minutes=10), "e"), (3, 8, t0 + dt.timedelta(hours=5), "x")]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in")
    with keyed.timed_state(spark):
        out = keyed.keyed_cycles(ss.read_events_stream(spark, f"{folder}/in", EVENTS), "k", "t", "w", "s", "e", "id", "1 hour")
        assert [tuple(r) for r in ss.run_to_table(out, "keyed").collect()] == [(7, t0, rows[1][2])]


def test_calls_to_the_state_store_do_not_grow_with_events_or_closed_entities():
    """A part of 300 entities: one list and one timer in, one look-up an entity and one frame out."""
    pytest.importorskip("google.protobuf")
    import collections
    import types

    import pandas as pd
    from pyspark.sql import types as T

    from tidemark.streaming import keyed

    calls, held, waiting = collections.Counter(), {}, []

    class Waiting:
        def appendList(self, rows):
            calls["list"] += 1
            waiting.extend(rows)

        def get(self):
            calls["list"] += 1
            return iter(list(waiting))

        def clear(self):
            calls["list"] += 1
            waiting.clear()

    class Opened:
        def getValue(self, k):
            calls["get"] += 1
            return held.get(k)

        def updateValue(self, k, v):
            calls["set"] += 1
            held[k] = v

    handle = types.SimpleNamespace(getMapState=lambda *a: Opened(), getListState=lambda *a: Waiting(), registerTimer=lambda at: calls.update(["timer"]))
    state = keyed.OpenStarts(T.StructField("k", T.LongType()), None)
    state.init(handle)
    rows = [(k, 1000 * k + 10 * i, str(i), i % 2 == 0) for k in range(300) for i in range(4 + k % 2)]
    values = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    list(state.handleInputRows((5,), iter([pd.DataFrame(rows, columns=["entity", "at", "tie", "is_start"])]), values))
    values.getCurrentWatermarkInMs = lambda: 10**9
    out = [x for _ in range(2) for x in state.handleExpiredTimer((5,), values, None)]  # a second timer finds nothing left
    assert len(out) == 1 and sorted(map(tuple, out[0].values.tolist())) == [(k, 1000 * k + a, 1000 * k + a + 10) for k in range(300) for a in (0, 20)]
    assert held == {(k,): (1000 * k + 40,) for k in range(1, 300, 2)}
    assert calls == {"list": 3, "timer": 1, "get": 300, "set": 150}


def test_pairing_is_that_of_the_batch_operator():
    from tidemark.streaming.keyed import close_cycles

    s, e = (lambda t: (t, "", True)), (lambda t: (t, "", False))
    assert close_cycles(None, [e(1), s(2), s(3), e(5), e(6), s(9)]) == (9, [(3, 5)])
    assert close_cycles(7, [e(8)]) == (None, [(7, 8)])
