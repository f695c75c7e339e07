"""Sorting, limits, top-k and set operations."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import sets as st
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum


@query("f1_multi_key_sort", "SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders ORDER BY 1, 2 DESC, 3")
def _(t):
    return t.orders.select("o_orderstatus", "o_orderdate", "o_orderkey").orderBy(
        F.asc("o_orderstatus"), F.desc("o_orderdate"), F.asc("o_orderkey")
    )


@query("f2_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "f3_top_n_others",
    f"""WITH s AS (SELECT p_brand, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
             r AS (SELECT *, row_number() OVER (ORDER BY total DESC, p_brand) AS rk FROM s)
        SELECT CASE WHEN rk <= 5 THEN p_brand ELSE 'Others' END AS p_brand, CAST(sum(total) AS DOUBLE) AS total, count(*) AS n_keys FROM r GROUP BY 1""",
)
def _(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = st.top_n_others(df, "p_brand", fx.money("l_extendedprice"), 5)
    return out.withColumn("total", F.col("total").cast("double"))


@query("f4_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 50")
def _(t):
    return st.page_after(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 50)


@query(
    "f5_value_counts",
    """WITH c AS (SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk FROM part GROUP BY 1)
       SELECT CASE WHEN rk <= 10 THEN value ELSE '(other)' END AS value, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values,
              round(sum(n)::DOUBLE / (SELECT count(*) FROM part), 8) AS share FROM c GROUP BY 1""",
)
def _(t):
    return st.value_counts(t.part, "p_brand", 10).withColumn("share", F.round("share", 8))


@query(
    "f6_violation_sample",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE NOT (l_shipdate >= o_orderdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
def _(t):
    df = t.order_lines
    df = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_orderdate")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return st.violations(df, F.col("l_shipdate") >= F.col("o_orderdate"), order, 20)


@query(
    "g1_union_all",
    "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src"))
    return st.union_all([a, t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src"))])


@query("g1_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return st.union_distinct(
        [t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))]
    )


@query("g2_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    k = F.col("l_partkey").alias("k")
    return st.common(t.lineitem.filter("l_returnflag = 'A'").select(k), t.lineitem.filter("l_returnflag = 'R'").select(k))


@query(
    "g3_except_both_ways",
    """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'),
            d AS (SELECT l_orderkey, l_linenumber, sum(d) AS d FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, CASE WHEN d > 0 THEN 'only_a' ELSE 'only_b' END AS side, CAST(abs(d) AS BIGINT) AS copies FROM d WHERE d <> 0""",
)
def _(t):
    cols = ["l_orderkey", "l_linenumber"]
    return st.diff_sets(
        t.lineitem.filter("l_returnflag <> 'A'").select(*cols), t.lineitem.filter("l_returnflag <> 'R'").select(*cols)
    )


@query(
    "g4_insert_new",
    """SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000 UNION ALL
       SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
)
def _(t):
    target = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("k"))
    return st.insert_new(target, t.customer.select(F.col("c_custkey").alias("k")), ["k"])
