"""Structured Streaming sources, checks and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.columns import micros
from tidemark.operators.rules import RowRule, failed_rules
from tidemark.session import new_path


def read_events_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """File-based event source; a broker source only changes ``format`` and options.

    ``path`` is a folder of files or one file. The reader takes a plain path for a
    folder only, so the last character is made a pattern, which fits either.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = path.rstrip("/")
    return reader.parquet(path if "*" in path else f"{path[:-1]}[{path[-1]}]")


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str) -> DataFrame:
    """JSON values of a topic as typed columns (needs the public Kafka connector jar)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), "timestamp")
    return parsed.select("v.*", F.col("timestamp").alias("_broker_ts"))


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; parquet may hold wall-clock ones."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a written table and read it back."""
    spark = stream.sparkSession
    path, ckpt = new_path(spark, f"stream-{name}"), new_path(spark, f"ckpt-{name}")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
    run = writer.trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive ``handle(batch, batch_id)`` over everything available."""
    run = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def dedup_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One row per key; state is dropped once the watermark passes the delay."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_kpi(df: DataFrame, ts: str, width: str, by: Sequence[str], value: str, delay: str) -> DataFrame:
    """Tumbling-window count and exact sum; a window is emitted once it is complete."""
    w = event_time(df, ts).withWatermark(ts, delay)
    g = w.groupBy(F.window(ts, width), *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total")
    )
    wall = {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
    return g.select(*[c.cast("timestamp_ntz").alias(n) for n, c in wall.items()], *by, "n", "total")


def finalise_after(df: DataFrame, ts: str, unit: str, buffer: str, by: Sequence[str], value: str) -> DataFrame:
    """Close a period only when the buffer after its end has passed."""
    return windowed_kpi(df, ts, f"1 {unit}", by, value, buffer)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: a replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def route_late(df: DataFrame, event: str, load: str, allowed_hours: float, base: str) -> tuple[str, str]:
    """Split rows by lateness into a main and a side table; returns both paths."""
    main, side = f"{base}/on_time", f"{base}/late"

    def handle(batch: DataFrame, batch_id: int) -> None:
        late = (micros(load) - micros(event)) / F.lit(3.6e9) > allowed_hours
        _write_batch(batch.filter(~late), main, batch_id)
        _write_batch(batch.filter(late), side, batch_id)

    run_batches(df, handle, f"{base}/checkpoint")
    return main, side


def enrich_stream(df: DataFrame, dim: DataFrame, on: str, key: str) -> DataFrame:
    """Stream-static left join; the dimension's list of files is that of the frame given."""
    return df.join(dim, F.col(on) == F.col(key), "left")


def pair_streams(a: DataFrame, b: DataFrame, on: str, a_ts: str, b_ts: str, within: str, delay: str) -> DataFrame:
    """Each left event with the right events of the same key that follow within a time span."""
    left = event_time(a, a_ts).withWatermark(a_ts, delay)
    right = event_time(b, b_ts).withColumnRenamed(on, "_on").withWatermark(b_ts, delay)
    cond = (F.col(on) == F.col("_on")) & (F.col(b_ts) > F.col(a_ts)) & (F.col(b_ts) <= F.col(a_ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right, cond, "inner").drop("_on")


def cycles_stream(
    df: DataFrame, key: str, ts: str, kind: str, start: str, end: str, order: Sequence[str], base: str, timeout: str | None = None
) -> str:
    """Start-end pairing per entity across micro-batches; returns the path of closed cycles.

    State is a table with one row per entity: its cycle number and open start.
    Each batch pairs its events together with the open starts in the same
    distributed way as the batch operator (a busy entity is spread over tasks),
    writes the cycles that closed and the next state, both under the batch number,
    so a replay reads the same old state and rewrites the same folders. Open starts
    are kept for ever, or with ``timeout`` given up once they are older and written
    to ``given_up`` below ``base``. Batches must not go back in time.
    """
    from tidemark.operators.business import build_cycles

    closed, states = f"{base}/cycles", f"{base}/state"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = batch.filter(F.col(kind).isin(start, end)).select(key, ts, kind, *order)
        if batch_id == 0:
            old = events.select(F.col(key).alias("_k"), F.lit(0).cast("long").alias("_no"), F.col(ts).alias("_open")).limit(0)
        else:
            old = spark.read.parquet(f"{states}/batch={batch_id - 1}")
        resumed = old.filter("_open IS NOT NULL").select(
            F.col("_k").alias(key), F.col("_open").alias(ts), F.lit(start).alias(kind),
            *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in order],
        )
        pairs = build_cycles(events.unionByName(resumed), key, ts, kind, start, end, order)
        before = old.select("_k", (F.col("_no") - F.col("_open").isNotNull().cast("long")).alias("_base"))
        pairs = pairs.join(before, F.col(key) == F.col("_k"), "left").drop("_k")
        pairs = pairs.withColumn("cycle_no", F.col("cycle_no") + F.coalesce("_base", F.lit(0))).drop("_base")
        work = f"{base}/work/batch={batch_id}"
        pairs.write.mode("overwrite").parquet(work)
        pairs = spark.read.parquet(work)
        _write_batch(pairs.filter("ended_at IS NOT NULL"), closed, batch_id)
        last = pairs.groupBy(key).agg(F.max_by(F.struct("cycle_no", "started_at", "ended_at"), "cycle_no").alias("_l"))
        both = old.join(last, F.col("_k") == F.col(key), "full")
        opened = F.when(F.col("_l").isNull(), F.col("_open")).when(F.col("_l.ended_at").isNull(), F.col("_l.started_at"))
        state = both.select(F.coalesce("_k", key).alias("_k"), F.coalesce("_l.cycle_no", "_no").alias("_no"), opened.alias("_open"))
        if timeout is not None:
            limit = events.agg(F.max(ts)).scalar() - F.expr(f"INTERVAL {timeout}")
            old_start = F.coalesce(F.col("_open") < limit, F.lit(False))
            _write_batch(state.filter(old_start), f"{base}/given_up", batch_id)
            state = state.withColumn("_open", F.when(~old_start, F.col("_open")))
        _write_batch(state, states, batch_id)

    run_batches(df, handle, f"{base}/checkpoint")
    return closed


RUNS = "level int, first long, last long, folder string"


def _store(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)


def _runs(spark: SparkSession, path: str, batch_id: int) -> list[dict]:
    """The live runs after a batch, newest last; a few rows."""
    if batch_id < 0:
        return []
    found = spark.read.schema(RUNS).parquet(f"{path}/manifest/batch={batch_id}").collect()
    return sorted((r.asDict() for r in found), key=lambda r: r["first"])


def upsert_stream(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str], fan_in: int = 4) -> None:
    """Keep the newest row per key of a stream in runs that are merged as they grow; read with ``read_upserted``.

    A batch is a run of level 0 in its own folder. Whenever ``fan_in`` runs of one level stand
    together, they are merged, the newest row per key, into one run of the next
    level, dealt and sorted by key: each row is rewritten once per level, and there
    are never more than ``fan_in`` - 1 runs a level, so that readers merge few. The manifest of a
    batch lists the live runs and is written last. A replayed batch starts
    from the manifest before it and rewrites the same folders. Runs that two manifests
    no longer list are removed, which leaves readers a batch's time.
    """
    from tidemark.operators.windows import dedup_latest

    newest = [F.desc(c) for c in order]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _runs(spark, path, batch_id - 1)
        live = [*before, {"level": 0, "first": batch_id, "last": batch_id, "folder": f"log/batch={batch_id}"}]
        written = [live[-1]["folder"]]
        dedup_latest(batch, key, newest).write.mode("overwrite").parquet(f"{path}/{written[0]}")
        while len(live) >= fan_in and len({r["level"] for r in live[-fan_in:]}) == 1:
            parts, live = live[-fan_in:], live[:-fan_in]
            run = {"level": parts[0]["level"] + 1, "first": parts[0]["first"], "last": batch_id}
            run["folder"] = f"runs/level={run['level']}-{run['first']}-{run['last']}"
            merged = dedup_latest(spark.read.parquet(*[f"{path}/{r['folder']}" for r in parts]), key, newest)
            merged.hint("rebalance", *key).sortWithinPartitions(*key).write.mode("overwrite").parquet(f"{path}/{run['folder']}")
            live.append(run)
            written.append(run["folder"])
        rows = [tuple(r[c] for c in ("level", "first", "last", "folder")) for r in live]
        spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")
        for folder in set(written) - {r["folder"] for r in live}:  # merged at once, so that no manifest lists it
            _remove(spark, f"{path}/{folder}")
        store, old = _store(spark, f"{path}/manifest/batch={batch_id - 2}")
        if batch_id >= 2 and store.exists(old):  # a replay finds it removed
            held = {r["folder"] for r in [*before, *live]}
            for run in _runs(spark, path, batch_id - 2):
                if run["folder"] not in held:
                    _remove(spark, f"{path}/{run['folder']}")
            _remove(spark, f"{path}/manifest/batch={batch_id - 2}")

    run_batches(df, handle, f"{path}/checkpoint")


def read_upserted(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows: the newest per key over the runs of the latest manifest."""
    from tidemark.operators.windows import dedup_latest

    newest = spark.read.parquet(f"{path}/manifest").agg(F.max("batch")).first()[0]
    folders = [f"{path}/{r['folder']}" for r in _runs(spark, path, newest)]
    return dedup_latest(spark.read.parquet(*folders), key, [F.desc(c) for c in order])


def mark_failures(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Row rules inside the stream: names of the broken rules per row."""
    return df.withColumn("failed_rules", failed_rules(rules))


def validate_stream(df: DataFrame, rules: Sequence[RowRule], base: str) -> tuple[str, str]:
    """Good rows and quarantined rows to two tables; returns both paths."""
    good, bad = f"{base}/good", f"{base}/quarantine"

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch.filter(F.size("failed_rules") == 0).drop("failed_rules"), good, batch_id)
        _write_batch(batch.filter(F.size("failed_rules") > 0), bad, batch_id)

    run_batches(mark_failures(df, rules), handle, f"{base}/checkpoint")
    return good, bad


def monitor_stream(df: DataFrame, ts: str, base: str) -> str:
    """Write the rows and one volume and freshness record per batch, read off the written files."""
    data, ledger = f"{base}/data", f"{base}/ledger"

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, data, batch_id)
        stamp = F.col(ts).cast("timestamp")
        row = batch.sparkSession.read.parquet(f"{data}/batch={batch_id}").agg(
            F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("n_rows"),
            F.min(stamp).alias("min_ts"), F.max(stamp).alias("max_ts"),
        )
        _write_batch(row, ledger, batch_id)

    run_batches(df, handle, f"{base}/checkpoint")
    return ledger
