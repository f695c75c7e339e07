"""Reconciliation and regression."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import reconcile as rc
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum, union


def mart(t):
    """Orders as a second system would hold them: upper-case priority, corrected finished prices."""
    fixed = F.when(F.col("o_orderstatus") == "F", F.round(F.col("o_totalprice") + 0.01, 2)).otherwise(F.col("o_totalprice"))
    df = t.orders.withColumns({"o_totalprice": fixed, "o_orderpriority": F.lower("o_orderpriority")})
    return df.filter("o_orderpriority <> '5-low' OR o_orderstatus <> 'P'")


MART = """mart AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice + 0.01, 2) ELSE o_totalprice END AS o_totalprice,
  o_orderdate, lower(o_orderpriority) AS o_orderpriority FROM orders WHERE lower(o_orderpriority) <> '5-low' OR o_orderstatus <> 'P')"""


@query(
    "k1_control_total",
    f"""WITH {MART}, s AS (SELECT (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM mart) AS a, (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS b)
        SELECT a::DOUBLE AS total_a, b::DOUBLE AS total_b, (a - b)::DOUBLE AS difference, abs(a - b) <= 0.01 AS passed FROM s""",
)
def _(t):
    return rc.reconcile_total(mart(t), t.orders, "o_totalprice", "o_totalprice", 0.01)


@query(
    "k2_reconcile_by",
    f"""WITH {MART}, a AS (SELECT o_orderstatus, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM mart GROUP BY ALL),
             b AS (SELECT o_orderstatus, lower(o_orderpriority) AS o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY ALL)
        SELECT o_orderstatus, o_orderpriority, a.s::DOUBLE AS o_totalprice_a, b.s::DOUBLE AS o_totalprice_b, (coalesce(a.s, 0) - coalesce(b.s, 0))::DOUBLE AS o_totalprice_residual
        FROM a FULL JOIN b USING (o_orderstatus, o_orderpriority)""",
)
def _(t):
    source = t.orders.withColumn("o_orderpriority", F.lower("o_orderpriority"))
    return rc.reconcile_by(mart(t), source, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


@query(
    "k3_three_levels",
    f"""WITH {MART}, j AS (SELECT o.o_orderkey IS NULL OR m.o_orderkey IS NULL AS lost, o.o_orderpriority AS op, m.o_orderpriority AS mp, o.o_totalprice AS ot, m.o_totalprice AS mt FROM orders o FULL JOIN mart m USING (o_orderkey)),
             s AS (SELECT count(*) FILTER (lost OR op <> mp OR ot <> mt) AS tech, count(*) FILTER (lost OR lower(op) <> mp OR round(ot) <> round(mt)) AS sem,
                          coalesce(sum(CAST(mt AS DECIMAL(18,2))), 0) - sum(CAST(ot AS DECIMAL(18,2))) AS diff FROM j)
        SELECT 'technical' AS level, tech::DOUBLE AS observed, tech = 0 AS passed FROM s UNION ALL SELECT 'semantic', sem::DOUBLE, sem = 0 FROM s
        UNION ALL SELECT 'business', diff::DOUBLE, abs(diff) <= 100 FROM s""",
)
def _(t):
    fixes = {"o_orderpriority": fx.norm_text, "o_totalprice": lambda c: F.round(c)}
    return rc.three_level(mart(t), t.orders, ["o_orderkey"], fixes, "o_totalprice", 100)


@query(
    "k4_relative_drift",
    f"""WITH {MART}, a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM mart GROUP BY 1), b AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1)
        SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0)))::DOUBLE / sum(abs(b.s))::DOUBLE, 10) AS drift FROM a FULL JOIN b USING (o_custkey)""",
)
def _(t):
    return rc.relative_drift(mart(t), t.orders, ["o_custkey"], "o_totalprice").select(F.round("drift", 10).alias("drift"))


@query(
    "k5_row_diff",
    f"""WITH {MART} SELECT o_orderkey, CASE WHEN m.o_custkey IS NULL THEN 'missing' ELSE 'changed' END AS status,
             CASE WHEN m.o_custkey IS NULL THEN NULL ELSE concat_ws(',', CASE WHEN o.o_totalprice <> m.o_totalprice THEN 'o_totalprice' END, CASE WHEN o.o_orderpriority <> m.o_orderpriority THEN 'o_orderpriority' END) END AS changed
        FROM orders o FULL JOIN mart m USING (o_orderkey) WHERE m.o_custkey IS NULL OR o.o_totalprice <> m.o_totalprice OR o.o_orderpriority <> m.o_orderpriority""",
)
def _(t):
    out = rc.row_diff(t.orders, mart(t), ["o_orderkey"])
    return out.withColumn("changed", F.array_join("changed", ","))


@query("k6_idempotent_run", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return rc.assert_idempotent(lambda: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")))


@query(
    "k7_additivity",
    f"""WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {msum('o_totalprice')} AS v FROM orders GROUP BY 1),
             m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {msum('o_totalprice')} AS v FROM orders WHERE o_totalprice < 495000 GROUP BY 1)
        SELECT month, d.v AS v_a, m.v AS v_b, (CAST(d.v AS DECIMAL(18,2)) - CAST(m.v AS DECIMAL(18,2)))::DOUBLE AS v_residual FROM d FULL JOIN m USING (month) WHERE abs(d.v - m.v) > 0.005""",
)
def _(t):
    month = fx.period("o_orderdate", "month").alias("month")
    atomic = t.orders.select(month, F.col("o_totalprice").alias("v"))
    agg = t.orders.filter("o_totalprice < 495000").groupBy(month).agg(fx.money_sum("o_totalprice").alias("v"))
    return rc.additivity(atomic, agg, ["month"], "v")


@query(
    "k8_sampled_cells",
    f"""WITH {MART}, p AS (SELECT * FROM orders ORDER BY md5(o_orderkey || '|42') LIMIT 200)
        """
    + union(
        f"""SELECT p.o_orderkey, '{c}' AS "column", p.{c} AS value_a, m.{c} AS value_b, p.{c} IS NOT DISTINCT FROM m.{c} AS is_equal FROM p LEFT JOIN mart m USING (o_orderkey)"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def _(t):
    return rc.sample_cells(t.orders, mart(t), "o_orderkey", ["o_orderstatus", "o_orderpriority"], 200)
