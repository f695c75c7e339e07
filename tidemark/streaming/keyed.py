"""Cycles from keyed streaming state: what is open per entity, and timers in event time.

``streams.cycles_stream`` keeps its state in tables and spreads a busy entity over tasks;
here the state store holds one open start per entity, and the events that the watermark has not
passed yet. That suits very many entities with few events each: a batch only touches the open starts of
entities it has due events for, and the waiting events of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.streams import event_time

# Fixed value: the state store that can hold several states and timers per key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 4096
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession):
    """Start queries with keyed timers inside this block; the session's own state store comes back after it."""
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE_KEY, before)


def close_cycles(opened: int | None, events: list[tuple]) -> tuple[int | None, list[tuple]]:
    """Pair ordered (time, tie, is start) events: each start with the first end before the next start."""
    closed = []
    for at, _, is_start in events:
        if is_start:
            opened = at
        elif opened is not None:
            closed.append((opened, at))
            opened = None
    return opened, closed


class OpenStarts(StatefulProcessor):
    """Events wait until the watermark has passed them, and are then paired in order of time.

    Times are whole microseconds. Entities are dealt into parts by hash: a part keeps the waiting events of its
    entities and the open start of each, so the calls to the state store and the timers are those of the parts and
    of starts that change, not some for every entity. One timer per part stands at its earliest waiting event; others,
    with ``timeout`` microseconds, give up starts that stay open.
    """

    def __init__(self, key: T.StructField, timeout: int | None):
        self.key, self.timeout = key, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        entity = T.StructField("entity", self.key.dataType)
        times = [T.StructField("at", T.LongType()), T.StructField("tie", T.StringType()), T.StructField("is_start", T.BooleanType())]
        self.handle, self.done = handle, None
        self.opened = handle.getMapState("opened", T.StructType([entity]), T.StructType(times[:1]))
        self.waiting = handle.getListState("waiting", T.StructType([entity, *times]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = [r for part in rows for r in zip(*(part[c].tolist() for c in ("entity", "at", "tie", "is_start")))]
        fresh = [r for r in fresh if r[1] // 1000 >= mark]  # later ones were due before
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(r[1] for r in fresh))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, mark):  # another timer of this part has settled all that is due
            return
        self.done = (key, mark)
        due, later, closed = {}, [], []
        for entity, *event in self.waiting.get():
            if event[0] // 1000 < mark:
                due.setdefault(entity, []).append(tuple(event))
            else:
                later.append((entity, *event))
        if later:
            self.waiting.put(later)
            self._wake(min(r[1] for r in later))
        else:
            self.waiting.clear()
        for entity, events in due.items():
            held = self.opened.getValue((entity,))
            before = None if held is None else held[0]
            after, pairs = close_cycles(before, sorted(events))
            closed += [(entity, *pair) for pair in pairs]
            if after is None and before is not None:
                self.opened.removeKey((entity,))
            elif after != before:
                self.opened.updateValue((entity,), (after,))
                if self.timeout is not None and (after + self.timeout) // 1000 >= mark:
                    self._wake(after + self.timeout)
        if self.timeout is not None:
            given_up = [(e, at) for (e,), (at,) in self.opened.iterator() if (at + self.timeout) // 1000 < mark]
            for entity, at in given_up:
                self.opened.removeKey((entity,))
                closed.append((entity, at, None))
        if closed:
            entities, started, ended = zip(*closed)
            yield pd.DataFrame({self.key.name: list(entities), "started": pd.array(started, "Int64"), "ended": pd.array(ended, "Int64")})

    def close(self) -> None:
        pass


def keyed_cycles(
    df: DataFrame, key: str, ts: str, kind: str, start: str, end: str, tie: str, delay: str, timeout_hours: float | None = None, parts: int = PARTS
) -> DataFrame:
    """Streaming rows (key, started_at, ended_at) of cycles whose end the watermark has passed.

    Events may come in any order within ``delay``; those behind it are dropped, and equal times go by ``tie``. With
    ``timeout_hours``, a start that is open for longer is given up with a NULL end. Start the query inside ``timed_state``.
    ``parts`` holds for the life of a stream: state is kept by part.
    """
    wanted = F.when(F.col(ts).isNotNull() & F.col(key).isNotNull(), F.col(kind))  # names the time, or else the filter moves below the watermark, which is that of all events
    marked = event_time(df, ts).withWatermark(ts, delay).filter(wanted.isin(start, end))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    events = marked.select(part, F.col(key).alias("entity"), ts, F.unix_micros(ts).alias("at"), F.col(tie).cast("string").alias("tie"), (F.col(kind) == start).alias("is_start"))
    field = df.schema[key]
    schema = T.StructType([T.StructField(key, field.dataType), T.StructField("started", T.LongType()), T.StructField("ended", T.LongType())])
    timeout = None if timeout_hours is None else int(timeout_hours * 3_600_000_000)
    paired = events.groupBy("part").transformWithStateInPandas(OpenStarts(field, timeout), schema, "Append", "EventTime")
    wall = {"started_at": "started", "ended_at": "ended"}
    return paired.select(key, *[F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for n, c in wall.items()])
