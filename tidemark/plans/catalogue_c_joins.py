"""Joins."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import joins as jn
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum


@query(
    "c1_inner_join",
    "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_custkey", "c_mktsegment")


@query(
    "c2_left_join_on",
    """SELECT c_custkey, count(o_orderkey) AS n_open FROM customer
       LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1""",
)
def _(t):
    df = jn.left_join_on(t.customer, t.orders, "c_custkey", "o_custkey", F.col("o_orderstatus") == "O")
    return df.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_open"))


@query(
    "c3_star_join",
    f"""SELECT coalesce(c.c_custkey, -1) AS o_custkey_key, count(*) AS n, {msum('o_totalprice')} AS revenue
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey GROUP BY 1""",
)
def _(t):
    dim = t.customer.filter("c_acctbal > 0").select("c_custkey", F.col("c_custkey").alias("sk"))
    star = jn.star_join(t.orders, {"o_custkey": (dim, "c_custkey", "sk")})
    return star.groupBy("o_custkey_key").agg(F.count("*").alias("n"), fx.money_sum("o_totalprice").alias("revenue"))


@query(
    "c4_full_compare",
    """SELECT coalesce(a.nationkey, b.nationkey) AS nationkey, a.n AS n_a, b.n AS n_b,
              CASE WHEN b.nationkey IS NULL THEN 'only_a' WHEN a.nationkey IS NULL THEN 'only_b' ELSE 'both' END AS side
       FROM (SELECT c_nationkey AS nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY 1) b USING (nationkey)""",
)
def _(t):
    a = t.customer.filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n"))
    return jn.full_compare(a, b, ["nationkey"], ["n"])


@query(
    "c5_key_by_period_spine",
    """SELECT s.c_mktsegment, CAST(m.period AS DATE) AS period, count(o_orderkey) AS n
       FROM (SELECT DISTINCT c_mktsegment FROM customer) s
       CROSS JOIN (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP FROM orders), (SELECT max(o_orderdate)::TIMESTAMP FROM orders), INTERVAL 1 MONTH)) AS period) m
       LEFT JOIN (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate) AS mon, o_orderkey
                  FROM orders JOIN customer ON o_custkey = c_custkey) o ON o.seg = s.c_mktsegment AND o.mon = m.period
       GROUP BY 1, 2""",
)
def _(t):
    first, last = (t.orders.agg(F.trunc(f("o_orderdate"), "month")).scalar() for f in (F.min, F.max))
    keys = t.customer.select("c_mktsegment").distinct().withColumns({"_first": first, "_last": last})
    spine = jn.cross_spine(keys, "_first", "_last", "1 month").drop("_first", "_last")
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.groupBy("c_mktsegment", fx.period("o_orderdate", "month").alias("period")).agg(F.count("*").alias("n"))
    return spine.join(facts, ["c_mktsegment", "period"], "left").fillna(0, ["n"])


PRIO = "nullif(o_orderpriority, '5-LOW')"


@query(
    "c6_nullsafe_join",
    f"""SELECT a.p, a.n AS n_f, b.n AS n_o
        FROM (SELECT {PRIO} AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
        JOIN (SELECT {PRIO} AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b
          ON a.p IS NOT DISTINCT FROM b.p""",
)
def _(t):
    base = t.orders.withColumn("p", fx.nullify("o_orderpriority", ["5-LOW"]))
    a = base.filter("o_orderstatus = 'F'").groupBy("p").agg(F.count("*").alias("n_f"))
    b = base.filter("o_orderstatus = 'O'").groupBy("p").agg(F.count("*").alias("n_o"))
    return jn.join_nullsafe(a, b, ["p"])


@query(
    "c7_orphans",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(t):
    return jn.orphans(t.orders, "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "c8_semi_join",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)",
)
def _(t):
    return jn.semi(t.customer, t.orders.filter("o_totalprice > 490000"), "c_custkey", "o_custkey").select("c_custkey")


VERSIONS = """versions AS (SELECT o_custkey AS bk, o_orderdate AS vf,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS vt, prio
  FROM (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS prio FROM orders GROUP BY ALL))"""


def customer_versions(t):
    """Priority of each customer over time: a version starts with every order day."""
    from pyspark.sql import Window as W

    days = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderpriority").alias("prio"))
    w = W.partitionBy("o_custkey").orderBy("o_orderdate")
    return days.select(
        F.col("o_custkey").alias("bk"),
        F.col("o_orderdate").alias("row_effective_from"),
        F.lead("o_orderdate").over(w).alias("row_effective_to"),
        "prio",
    )


for _name, _dense in (("c9_scd2_range_join", False), ("c9_scd2_dense_join", True)):

    @query(
        _name,
        f"""WITH {VERSIONS}
            SELECT prio, l_returnflag, count(*) AS n, {msum('l_extendedprice')} AS revenue
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            LEFT JOIN versions ON bk = o_custkey AND l_shipdate >= vf AND (vt IS NULL OR l_shipdate < vt)
            GROUP BY ALL""",
    )
    def _(t, dense=_dense):
        return _versioned_revenue(t, dense)


def _versioned_revenue(t, dense):
    fact = t.order_lines
    fact = fact.select("o_custkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    out = jn.join_scd2(fact, customer_versions(t), "o_custkey", "l_shipdate", dim_bk="bk", dense=dense)
    return out.groupBy("prio", "l_returnflag").agg(
        F.count("*").alias("n"), fx.money_sum("l_extendedprice").alias("revenue")
    )


ASOF = """SELECT p.event_id, p.user_id, p.ts, v.ts AS matched_ts, v.value AS last_value
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v
    ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _asof(t, tolerance=None):
    ev = t.events
    left = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"))
    return jn.asof_join(left, right, ["user_id"], "ts", "ts", ["last_value"], tolerance)


@query("c10_asof_join", ASOF)
def _(t):
    return _asof(t)


@query(
    "c10_asof_join_tolerance",
    f"""SELECT event_id, user_id, ts, CASE WHEN near THEN matched_ts END AS matched_ts,
              CASE WHEN near THEN last_value END AS last_value
        FROM (SELECT *, matched_ts >= ts - INTERVAL 6 HOUR AS near FROM ({ASOF}))""",
)
def _(t):
    return _asof(t, "6 HOURS")


INTERVALS = f"""SELECT c.event_id, c.user_id, c.ts AS start_ts, c.ts + INTERVAL 36 HOUR AS end_ts,
              count(r.ts) AS n_readings, coalesce({msum('r.value')}, 0) AS total
        FROM (SELECT * FROM events WHERE event_type = 'signup') c
        LEFT JOIN events r ON r.user_id = c.user_id AND r.ts >= c.ts AND r.ts < c.ts + INTERVAL 36 HOUR
        GROUP BY 1, 2, 3, 4"""


@query("c11_interval_sums", INTERVALS)
def _(t):
    cycles = t.events.filter("event_type = 'signup'").select(
        "event_id", "user_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("end_ts")
    )
    readings = t.events.select("user_id", "ts", "value")
    out = jn.interval_sums(cycles, readings, ["event_id"], ["user_id"], "start_ts", "end_ts", "ts", {"total": "value"})
    return out.withColumn("total", F.col("total").cast("double"))


@query("c11_interval_agg", INTERVALS)
def _(t):
    cycles = t.events.filter("event_type = 'signup'").select(
        "event_id", "user_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("end_ts")
    )
    readings = t.events.select("user_id", "ts", "value")
    aggs = {"n_readings": F.count("ts"), "total": F.coalesce(fx.money_sum("value"), F.lit(0.0))}
    return jn.interval_agg(cycles, readings, ["event_id"], ["user_id"], "start_ts", "end_ts", "ts", aggs)


@query(
    "c12_lateral_top",
    """SELECT n_name, c.c_custkey, c.c_acctbal FROM nation,
       LATERAL (SELECT * FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c""",
)
def _(t):
    out = jn.lateral_top(t.nation, t.customer, "n_nationkey", "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 2)
    return out.select("n_name", "c_custkey", "c_acctbal")


@query(
    "c13_or_join",
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey OR c_nationkey = n_regionkey""",
)
def _(t):
    out = jn.join_or(t.customer, t.nation, ("c_nationkey", "n_nationkey"), ("c_nationkey", "n_regionkey"))
    return out.select("c_custkey", "n_name")


@query(
    "c14_agg_then_join",
    f"""SELECT n_nationkey, revenue, balance FROM
        (SELECT c_nationkey AS n_nationkey, {msum('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        FULL JOIN (SELECT s_nationkey AS n_nationkey, {msum('s_acctbal')} AS balance FROM supplier GROUP BY 1) USING (n_nationkey)""",
)
def _(t):
    sales = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    sales = sales.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(fx.money_sum("o_totalprice").alias("revenue"))
    sup = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(fx.money_sum("s_acctbal").alias("balance"))
    return jn.agg_then_join([sales, sup], "n_nationkey")


@query(
    "c15_join_key_profile",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
            b AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1),
            j AS (SELECT CAST(sum(a.n * b.n) AS BIGINT) AS join_rows FROM a JOIN b USING (k))
       SELECT 'a' AS side, CAST(sum(n) AS BIGINT) AS n_rows, count(k) AS n_keys, 0::BIGINT AS n_null, max(n) AS max_per_key,
              (SELECT join_rows FROM j) AS join_rows FROM a
       UNION ALL SELECT 'b', CAST(sum(n) AS BIGINT), count(k), 0, max(n), (SELECT join_rows FROM j) FROM b""",
)
def _(t):
    return jn.join_key_profile(t.orders, t.customer, "o_custkey", "c_custkey")


@query(
    "c16_no_fanout",
    "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return jn.assert_no_fanout(t.orders, joined).select("o_orderkey", "c_mktsegment")


@query(
    "c17_relationship_matrix",
    """SELECT 'orders-customer' AS relationship, 'N:1' AS cardinality, count(*) AS rows_keyed,
              count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS rows_orphan,
              (SELECT count(*) FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)) AS members_unused,
              round(100.0 * count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(*), 4)::DOUBLE AS ri_pct
       FROM orders
       UNION ALL SELECT 'nation-region', 'N:1', count(*), 0, 0, 100.0 FROM nation""",
)
def _(t):
    good = t.customer.filter("c_acctbal > 0")
    return jn.relationship_matrix(
        [
            ("orders-customer", t.orders, "o_custkey", good, "c_custkey"),
            ("nation-region", t.nation, "n_regionkey", t.region, "r_regionkey"),
        ]
    )


@query(
    "c18_map_ids",
    """SELECT c_custkey, n_name, n_name IS NOT NULL AS is_mapped FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
)
def _(t):
    out = jn.map_ids(t.customer, t.nation.filter("n_regionkey <> 2"), "c_nationkey", "n_nationkey", "n_name")
    return out.select("c_custkey", "n_name", "is_mapped")
