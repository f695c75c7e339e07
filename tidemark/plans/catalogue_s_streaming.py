"""Structured Streaming runs over the event table (everything available, then stop)."""

from pyspark.sql import functions as F

from tidemark.operators import rules as rl
from tidemark.plans.registry import query
from tidemark.session import new_path
from tidemark.streaming import keyed, streams as ss


def stream(t):
    return ss.read_events_stream(t.spark, t.path("events"), t.events.schema)


@query("s1_dedup_stream", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    twice = stream(t).union(stream(t))
    out = ss.dedup_stream(twice, ["event_id"], "ts", "40 days").select("event_id", "user_id", "event_type")
    return ss.run_to_table(out, "dedup")


def _windows(width, start, step, delay):
    return f"""WITH w AS (SELECT {start} AS window_start, {start} + INTERVAL {step} AS window_end, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2, 3)
      SELECT * FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL {delay}"""


def _totals(df):
    return df.withColumn("total", F.col("total").cast("double"))


@query("s2_windowed_kpi", _windows("1 hour", "date_trunc('hour', ts)", "1 HOUR", "30 MINUTE"))
def _(t):
    return _totals(ss.run_to_table(ss.windowed_kpi(stream(t), "ts", "1 hour", ["event_type"], "value", "30 minutes"), "kpi"))


def loaded(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 3.6e9).cast("long")
    return stream(t).withColumn("loaded_at", F.timestamp_micros(micros))


@query(
    "s3_route_late",
    "SELECT CASE WHEN CAST(trunc(value * 3.6e9) AS BIGINT) / 3.6e9 > 12 THEN 'late' ELSE 'on_time' END AS route, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    main, side = ss.route_late(loaded(t), "ts", "loaded_at", 12, new_path(t.spark, "late"))
    a = t.spark.read.parquet(main).agg(F.lit("on_time").alias("route"), F.count("*").alias("n"))
    return a.unionByName(t.spark.read.parquet(side).agg(F.lit("late").alias("route"), F.count("*").alias("n")))


@query("s4_finalise_periods", _windows("1 day", "date_trunc('day', ts)", "1 DAY", "6 HOUR"))
def _(t):
    return _totals(ss.run_to_table(ss.finalise_after(stream(t), "ts", "day", "6 hours", ["event_type"], "value"), "closed"))


@query(
    "s5_enrich_stream",
    "SELECT event_id, c_mktsegment FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey",
)
def _(t):
    dim = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    out = ss.enrich_stream(stream(t).select("event_id", "user_id"), dim, "user_id", "c_custkey")
    return ss.run_to_table(out.select("event_id", "c_mktsegment"), "enriched")


@query(
    "s6_pair_streams",
    """SELECT a.event_id AS signup_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR
       WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""",
)
def _(t):
    a = stream(t).filter("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), "user_id", F.col("ts").alias("a_ts"))
    b = stream(t).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("b_ts"))
    out = ss.pair_streams(a, b, "user_id", "a_ts", "b_ts", "12 hours", "1 hour")
    return ss.run_to_table(out.select("signup_id", "purchase_id"), "pairs")


@query(
    "s7_stateful_cycles",
    """WITH m AS (SELECT user_id, ts, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cycle_no FROM events WHERE event_type IN ('signup', 'purchase')),
            c AS (SELECT user_id, CAST(cycle_no AS BIGINT) AS cycle_no, min(ts) FILTER (event_type = 'signup') AS started_at, min(ts) FILTER (event_type = 'purchase') AS ended_at FROM m WHERE cycle_no > 0 GROUP BY 1, 2)
       SELECT * FROM c WHERE ended_at IS NOT NULL""",
)
def _(t):
    path = ss.cycles_stream(stream(t), "user_id", "ts", "event_type", "signup", "purchase", ["event_id"], new_path(t.spark, "cycles"))
    return t.spark.read.parquet(path).select("user_id", "cycle_no", "started_at", "ended_at")


@query(
    "s7_keyed_state",
    """WITH m AS (SELECT user_id, ts, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cycle_no FROM events WHERE event_type IN ('signup', 'purchase')),
            c AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS started_at, min(ts) FILTER (event_type = 'purchase') AS ended_at FROM m WHERE cycle_no > 0 GROUP BY user_id, cycle_no)
       SELECT * FROM c WHERE ended_at < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM events)""",
)
def _(t):
    with keyed.timed_state(t.spark):
        out = keyed.keyed_cycles(stream(t), "user_id", "ts", "event_type", "signup", "purchase", "event_id", "6 hours")
        return ss.run_to_table(out, "keyed")


@query(
    "s8_upsert_stream",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def _(t):
    path = new_path(t.spark, "upsert")
    ss.upsert_stream(stream(t), path, ["user_id"], ["ts", "event_id"])
    return ss.read_upserted(t.spark, path, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "s9_validate_stream",
    """SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'accepted:event_type' END, CASE WHEN value > 20 THEN 'range:value' END) AS failed FROM events WHERE event_type = 'error' OR value > 20""",
)
def _(t):
    rules = [rl.accepted("event_type", ["view", "click", "signup", "purchase"]), rl.in_range("value", 0, 20)]
    _, bad = ss.validate_stream(stream(t), rules, new_path(t.spark, "validate"))
    return t.spark.read.parquet(bad).select("event_id", F.array_join("failed_rules", ",").alias("failed"))


@query("s10_monitor_stream", "SELECT count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def _(t):
    ledger = t.spark.read.parquet(ss.monitor_stream(stream(t), "ts", new_path(t.spark, "monitor")))
    return ledger.agg(
        F.sum("n_rows").alias("n_rows"), F.min("min_ts").cast("timestamp_ntz").alias("min_ts"), F.max("max_ts").cast("timestamp_ntz").alias("max_ts")
    )
