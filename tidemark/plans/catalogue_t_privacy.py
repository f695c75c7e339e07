"""Privacy, observability tables and user-defined functions."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import observe as ob
from tidemark.operators import privacy as pv
from tidemark.plans.registry import query
from tidemark.plans.sqltext import union
from tidemark.session import new_path


KEY = b"secret key from a vault"
IPAD, OPAD = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(
    "t1_pseudonyms",
    f"SELECT c_custkey, sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(c_name)))) AS c_name FROM customer",
)
def _(t):
    return pv.pseudonymize(t.customer.select("c_custkey", "c_name"), ["c_name"], KEY)


@query(
    "t2_mask",
    "SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS c_name FROM customer",
)
def _(t):
    return pv.mask(t.customer.select("c_custkey", "c_name"), ["c_name"])


@query(
    "t3_suppress_small_groups",
    """SELECT c_mktsegment, c_nationkey, CASE WHEN count(*) >= 12 THEN round(avg(c_acctbal), 4) END AS avg_balance, CASE WHEN count(*) >= 12 THEN count(*) END AS n, count(*) < 12 AS is_suppressed FROM customer GROUP BY 1, 2""",
)
def _(t):
    aggs = {"avg_balance": F.round(F.avg("c_acctbal"), 4), "n": F.count("*")}
    return pv.suppress_small(t.customer, ["c_mktsegment", "c_nationkey"], aggs, 12)


@query(
    "t3_k_anonymous_rows",
    "SELECT c_custkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) >= 12",
)
def _(t):
    return pv.k_anonymous(t.customer, ["c_mktsegment", "c_nationkey"], 12).select("c_custkey")


@query(
    "t4_row_level_security",
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name = (SELECT max(s_name) FROM supplier))""",
)
def _(t):
    user_map = t.supplier.select(F.col("s_name").alias("user"), F.col("s_nationkey").alias("value"))
    user = t.supplier.agg(F.max("s_name").alias("u")).first()["u"]
    return pv.rls(t.customer, user_map, user, "c_nationkey").select("c_custkey", "c_nationkey")


TREE = "e AS (SELECT c_custkey // 6 AS parent, c_custkey AS child FROM customer)"


def tree(t):
    """Every customer reports to the one with a sixth of its number."""
    return t.customer.select(F.floor(F.col("c_custkey") / 6).alias("parent"), F.col("c_custkey").alias("child"))


@query(
    "t5_manager_subtree",
    f"""WITH RECURSIVE {TREE}, r AS (SELECT min(c_custkey) AS node, 0 AS depth FROM customer WHERE c_acctbal > 0 UNION ALL SELECT child, depth + 1 FROM r JOIN e ON parent = node AND child <> parent) SELECT * FROM r""",
)
def _(t):
    root = t.customer.filter("c_acctbal > 0").agg(F.min("c_custkey").alias("node"))
    return pv.subtree(tree(t), root, "parent", "child")


def _count(pat):
    return f"len(regexp_extract_all(text, '{pat}'))"


@query(
    "t6_pii_scan",
    union(
        f"""SELECT 'text' AS "column", '{n}' AS pattern, CAST(sum({_count(p)}) AS BIGINT) AS n_matches, count(*) FILTER ({_count(p)} > 0) AS n_rows FROM documents"""
        for n, p in pv.PII_PATTERNS.items()
    ),
)
def _(t):
    return pv.pii_scan(t.documents, ["text"])


@query("u1_run_ledger", "SELECT 'orders_by_status' AS model, 'success' AS status, count(DISTINCT o_orderstatus) AS n_rows FROM orders")
def _(t):
    base = new_path(t.spark, "runs")
    build = lambda: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    ob.record_run(t.spark, f"{base}/ledger", "orders_by_status", build, f"{base}/data", lambda: dt.datetime(2024, 1, 1))
    return t.spark.read.parquet(f"{base}/ledger").select("model", "status", "n_rows")


RUNS = "runs AS (SELECT event_type AS model, CASE WHEN value > 15 THEN 'failed' ELSE 'success' END AS status, value AS duration FROM events)"


def runs(t):
    """Events read as pipeline runs: the value is the duration, long ones failed."""
    return t.events.select(
        F.col("event_type").alias("model"), F.when(F.col("value") > 15, "failed").otherwise("success").alias("status"), F.col("value").alias("duration")
    )


@query(
    "u2_pipeline_health",
    f"""WITH {RUNS} SELECT model, count(*) AS n_runs, count(*) FILTER (status = 'failed') AS n_failed, max(duration) AS slowest, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95,
              round(100.0 * count(*) FILTER (status = 'failed') / count(*), 6)::DOUBLE AS failed_pct FROM runs GROUP BY 1""",
)
def _(t):
    out = ob.pipeline_health(runs(t), "model", "status", "duration")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "failed_pct")})


@query(
    "u2_failure_pareto",
    f"""WITH {RUNS}, f AS (SELECT model, count(*) AS total FROM runs WHERE status = 'failed' GROUP BY 1), c AS (SELECT *, sum(total) OVER (ORDER BY total DESC, model ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum, sum(total) OVER ()::DOUBLE AS al FROM f)
        SELECT model, total, round(cum / al, 8) AS cum_share, CASE WHEN (cum - total) / al < 0.8 THEN 'A' WHEN (cum - total) / al < 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM c""",
)
def _(t):
    return ob.failure_pareto(runs(t), "model", "status").withColumn("cum_share", F.round("cum_share", 8))


@query(
    "u3_freshness_checks",
    union(
        f"""SELECT '{n}' AS "table", max({c}) AS newest, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max({c}))) / 3.6e9, 6) AS age_hours, CASE WHEN (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max({c}))) / 3.6e9 > 24 THEN 'error' WHEN (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max({c}))) / 3.6e9 > 6 THEN 'warn' ELSE 'pass' END AS status FROM {n}"""
        for n, c in (("events", "ts"), ("orders", "o_orderdate"))
    ),
)
def _(t):
    out = ob.freshness_checks({"events": (t.events, "ts"), "orders": (t.orders, "o_orderdate")}, "2024-01-31 00:00:00", 6, 24)
    return out.withColumn("age_hours", F.round("age_hours", 6))


@query(
    "u4_alerts",
    """WITH f AS (SELECT DISTINCT user_id, event_type, ts FROM events WHERE value > 12), p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS previous_at FROM f)
       SELECT *, coalesce(ts - previous_at <= INTERVAL 24 HOUR, false) AS is_suppressed FROM p""",
)
def _(t):
    results = t.events.withColumn("passed", F.col("value") <= 12)
    return ob.alerts(results, ["user_id", "event_type"], "ts")


@query(
    "u5_downstream_lineage",
    f"""WITH RECURSIVE {TREE}, r AS (SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 499500) UNION SELECT child, depth + 1 FROM r JOIN e ON parent = node AND child <> parent),
             m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT * FROM m WHERE depth > 0""",
)
def _(t):
    changed = t.orders.filter("o_totalprice > 499500").select(F.col("o_custkey").alias("node"))
    return ob.downstream(tree(t), changed, "parent", "child")


@query(
    "v1_reusable_rules",
    "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS by_macro, round(sum(l_extendedprice * (1 - l_discount)), 2) AS by_sql_function FROM lineitem GROUP BY 1",
)
def _(t):
    ob.register_net_price(t.spark)
    df = t.lineitem.select(
        "l_returnflag", ob.net_price(F.col("l_extendedprice"), F.col("l_discount")).alias("a"), F.expr("net_price(l_extendedprice, l_discount)").alias("b")
    )
    return df.groupBy("l_returnflag").agg(F.round(F.sum("a"), 2).alias("by_macro"), F.round(F.sum("b"), 2).alias("by_sql_function"))


@query("v2_vectorised_function", "SELECT event_id, round(ln(1 + value), 8) AS damped FROM events")
def _(t):
    import numpy as np

    damp = ob.vectorised(lambda s: np.log1p(s))
    return t.events.select("event_id", F.round(damp("value"), 8).alias("damped"))


@query("v3_own_aggregate", "SELECT event_type, round(exp(avg(ln(value + 1))) - 1, 6) AS geometric_mean FROM events GROUP BY 1")
def _(t):
    parts = {"s": F.sum(F.log(F.col("value") + 1)), "n": F.count("value")}
    out = ob.own_aggregate(t.events, ["event_type"], parts, F.exp(fx.safe_div("s", "n")) - 1, "geometric_mean")
    return out.withColumn("geometric_mean", F.round("geometric_mean", 6))


@query("v4_rows_from_rows", "SELECT event_id, 'k' AS prop, CAST(json_extract(props, '$.k') AS INTEGER) AS val FROM events")
def _(t):
    return ob.explode_props(t.events, "props", ["event_id"])


@query("v4_table_function", "SELECT event_id, 'k' AS prop, CAST(json_extract(props, '$.k') AS INTEGER) AS val FROM events")
def _(t):
    ob.register_expand_props(t.spark)
    return t.spark.sql("SELECT event_id, p.prop, p.val FROM {events}, LATERAL expand_props(props) AS p", events=t.events)
