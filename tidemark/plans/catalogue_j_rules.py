"""Data-quality rules, suites, gates."""

import datetime as dt

from pyspark.sql import functions as F, types as T

from tidemark.functions import columns as fx
from tidemark.operators import contract
from tidemark.operators import rules as r
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum
from tidemark.session import new_path

NOW = dt.datetime(2024, 2, 1)
PRIO = "nullif(o_orderpriority, '5-LOW')"


def lines(t):
    """Order lines with their order date."""
    df = t.order_lines
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate", "o_orderdate", "o_orderstatus",
    )


def suite(t, rules, df=None, tables=None):
    df = t.orders.withColumn("prio", fx.nullify("o_orderpriority", ["5-LOW"])) if df is None else df
    return r.run_suite({"t": df, **(tables or {})}, {"t": rules}).select("rule", "criticality", "observed_value", "passed")


def pct(bad, scope="true", src="orders"):
    return f"round(100.0 * count(*) FILTER (({scope}) AND ({bad})) / greatest(count(*) FILTER ({scope}), 1), 6)::DOUBLE"


def row_sql(rule, crit, bad, cap, scope="true", src="orders"):
    obs = pct(bad, scope)
    return f"SELECT '{rule}' AS rule, '{crit}' AS criticality, {obs} AS observed_value, {obs} <= {cap} AS passed FROM {src}"


@query(
    "j1_completeness",
    row_sql("completeness:prio", "critical", f"{PRIO} IS NULL", 0.1) + " UNION ALL "
    + row_sql("completeness:o_orderpriority", "informational", "o_orderpriority = '4-NOT SPECIFIED'", 5) + " UNION ALL "
    + row_sql("completeness:o_custkey", "important", "o_custkey IS NULL", 1),
)
def _(t):
    rules = [
        r.completeness("prio"),
        r.completeness("o_orderpriority", ["4-NOT SPECIFIED"], criticality="informational"),
        r.completeness("o_custkey", criticality="important"),
    ]
    return suite(t, rules)


@query(
    "j2_uniqueness",
    """WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT 'unique:o_orderkey' AS rule, 'critical' AS criticality, (count(*) - count(DISTINCT o_orderkey))::DOUBLE AS observed_value, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders
       UNION ALL SELECT 'unique:l_orderkey,l_linenumber', 'critical', round(100.0 * sum(n - 1) / sum(n), 6)::DOUBLE, abs(100.0 * sum(n - 1) / sum(n) - 23.6) <= 0.1 FROM d""",
)
def _(t):
    a = suite(t, [r.unique(["o_orderkey"])])
    return a.unionByName(suite(t, [r.unique(["l_orderkey", "l_linenumber"], 23.6)], t.lineitem))


@query(
    "j3_accepted_values",
    row_sql("accepted:o_orderstatus", "critical", "o_orderstatus NOT IN ('F', 'O')", 0) + " UNION ALL "
    + row_sql("accepted:prio", "critical", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')", 0, f"{PRIO} IS NOT NULL"),
)
def _(t):
    return suite(t, [r.accepted("o_orderstatus", ["F", "O"]), r.accepted("prio", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])])


@query(
    "j4_range",
    row_sql("range:o_totalprice", "important", "o_totalprice < 5000 OR o_totalprice > 495000", 0.5),
)
def _(t):
    return suite(t, [r.in_range("o_totalprice", 5000, 495000, 0.5, "important")])


@query(
    "j5_pattern_length",
    row_sql("pattern:p_brand", "critical", "NOT regexp_matches(p_brand, '^Brand#[0-9]{2}$')", 0, src="part") + " UNION ALL "
    + row_sql("max_length:p_name", "critical", "length(p_name) > 12", 0, src="part"),
)
def _(t):
    return suite(t, [r.pattern("p_brand", "^Brand#[0-9]{2}$"), r.max_length("p_name", 12)], t.part)


@query(
    "j6_reference_membership",
    """SELECT 'in_reference:o_custkey' AS rule, 'important' AS criticality, count(*)::DOUBLE AS observed_value, count(*) = 0 AS passed
       FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(t):
    return suite(t, [r.in_reference("o_custkey", "ref", "c_custkey")], tables={"ref": t.customer.filter("c_acctbal > 0")})


@query(
    "j7_not_null",
    row_sql("not_null:prio", "critical", f"{PRIO} IS NULL", 0) + " UNION ALL " + row_sql("not_null:o_orderdate", "critical", "o_orderdate IS NULL", 0),
)
def _(t):
    return suite(t, r.not_null(["prio", "o_orderdate"]))


LINES = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    "j8_invariants",
    row_sql("ships_after_order", "critical", "NOT (l_shipdate >= o_orderdate)", 1, src=LINES) + " UNION ALL "
    + row_sql("returned_implies_taxed", "critical", "l_returnflag = 'R' AND NOT (l_tax > 0)", 5, src=LINES),
)
def _(t):
    rules = [
        r.invariant("ships_after_order", F.col("l_shipdate") >= F.col("o_orderdate"), 1.0),
        r.invariant("returned_implies_taxed", r.implies(F.col("l_returnflag") == "R", F.col("l_tax") > 0), 5.0),
    ]
    return suite(t, rules, lines(t))


@query(
    "j9_expression_match",
    row_sql("line_price", "important", "NOT (abs(l_extendedprice - l_quantity * p_retailprice) <= 0.083)", 1.0, src="(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"),
)
def _(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    rule = r.expression_match("line_price", F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), 0.083, 1.0)
    return suite(t, [rule], df)


@query(
    "j10_foreign_key",
    """WITH c AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS fk FROM orders)
       SELECT 'foreign_key:fk' AS rule, 'critical' AS criticality, count(*) FILTER (fk NOT IN (SELECT c_custkey FROM customer))::DOUBLE AS observed_value,
              count(*) FILTER (fk NOT IN (SELECT c_custkey FROM customer)) <= 0 AS passed FROM c
       UNION ALL SELECT 'foreign_key:fk', 'important', count(*) FILTER (fk IS NULL)::DOUBLE, count(*) FILTER (fk IS NULL) <= 0 FROM c""",
)
def _(t):
    df = t.orders.withColumn("fk", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    rules = [
        r.foreign_key("fk", "customer", "c_custkey"),
        r.foreign_key("fk", "customer", "c_custkey", ignore_null=False, criticality="important"),
    ]
    return suite(t, rules, df, {"customer": t.customer})


@query(
    "j11_late_arriving",
    """SELECT CASE WHEN (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate)) / 3.6e9 <= 2160 THEN 'late_arriving' ELSE 'missing' END AS kind,
              count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
)
def _(t):
    dim = t.customer.filter("c_acctbal > 0")
    return r.ri_late(t.orders, "o_custkey", dim, "c_custkey", "o_orderdate", "2001-08-02 00:00:00", 2160)


@query(
    "j12_group_mean_range",
    """WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1), b AS (
         SELECT sum(CASE WHEN f = 'A' AND n >= 1000 AND m BETWEEN 24 AND 27 THEN 0 WHEN f = 'R' AND n >= 1000 AND m BETWEEN 30 AND 40 THEN 0 ELSE 1 END) AS bad FROM m WHERE f IN ('A', 'R'))
       SELECT 'group_mean:l_quantity' AS rule, 'important' AS criticality, bad::DOUBLE AS observed_value, bad = 0 AS passed FROM b""",
)
def _(t):
    bands = {"A": (24, 27, 1000), "R": (30, 40, 1000)}
    return suite(t, [r.group_mean_range("l_quantity", "l_returnflag", bands)], t.lineitem)


@query(
    "j13_event_order",
    """WITH e AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS a, min(ts) FILTER (event_type = 'view' AND value > 20) AS b, min(ts) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1),
            v AS (SELECT *, (a > b) OR (b > c) OR (b IS NULL AND a > c) AS bad FROM e)
       SELECT 'ordered:a,b,c' AS rule, 'critical' AS criticality, count(*) FILTER (bad)::DOUBLE AS observed_value, count(*) FILTER (bad) <= 50 AS passed FROM v""",
)
def _(t):
    def first(cond):
        return F.min(F.when(cond, F.col("ts")))

    kind = F.col("event_type")
    df = t.events.groupBy("user_id").agg(
        first(kind == "signup").alias("a"),
        first((kind == "view") & (F.col("value") > 20)).alias("b"),
        first(kind == "purchase").alias("c"),
    )
    return suite(t, [r.ordered(["a", "b", "c"], 50)], df)


@query(
    "j14_freshness_share",
    row_sql("freshness:ts", "critical", "NOT (value * 4 <= 90)", 1, src="events"),
)
def _(t):
    loaded = F.timestamp_micros(fx.micros("ts") + (F.col("value") * 4 * 60_000_000).cast("long"))
    return suite(t, [r.freshness_pct("ts", "loaded", 90, 99)], t.events.withColumn("loaded", loaded))


@query(
    "j15_partition_ready",
    """WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1)
       SELECT 'partition_ready:ts' AS rule, 'critical' AS criticality, (30 - count(*) FILTER (n >= 300))::DOUBLE AS observed_value, count(*) FILTER (n >= 300) = 30 AS passed FROM d""",
)
def _(t):
    return suite(t, [r.partition_ready("ts", 300, "2024-01-01", 30)], t.events)


@query(
    "j16_custom_sql",
    """SELECT 'cheap_open' AS rule, 'critical' AS criticality, count(*)::DOUBLE AS observed_value, count(*) <= 100 AS passed FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 10000""",
)
def _(t):
    sql = "SELECT count(*) AS bad FROM {t} WHERE o_orderstatus = 'O' AND o_totalprice < 10000"
    return suite(t, [r.custom_sql("cheap_open", sql, 100)])


@query(
    "j17_timeliness",
    """SELECT 'timeliness:ts' AS rule, 'critical' AS criticality, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9, 6) AS observed_value,
              (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9 <= 6 AND count(*) FILTER (ts > TIMESTAMP '2024-02-01') = 0 AND count(*) FILTER (ts < TIMESTAMP '2024-01-02') = 0 AS passed FROM events""",
)
def _(t):
    return suite(t, [r.timeliness("ts", "2024-01-31 00:00:00", 6, closed_before="2024-01-02 00:00:00")], t.events)


@query(
    "j18_bridge_weights",
    """WITH w AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 / c END) AS w FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) GROUP BY 1)
       SELECT 'bridge_balanced:l_orderkey' AS rule, 'critical' AS criticality, count(*) FILTER (abs(w - 1) > 1e-6)::DOUBLE AS observed_value, count(*) FILTER (abs(w - 1) > 1e-6) = 0 AS passed FROM w""",
)
def _(t):
    from tidemark.operators.windows import group_transform

    df = group_transform(t.lineitem, ["l_orderkey"], "l_orderkey", "count", "c")
    df = df.withColumn("w", F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0 / F.col("c")))
    return suite(t, [r.bridge_balanced("l_orderkey", "w")], df)


@query(
    "j19_tables_agree",
    """WITH a AS (SELECT o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1),
            b AS (SELECT o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 OR o_orderstatus = 'F' GROUP BY 1)
       SELECT 'tables_agree:o_totalprice' AS rule, 'important' AS criticality, count(*) FILTER (abs(a.s - b.s) > 0.01)::DOUBLE AS observed_value, count(*) FILTER (abs(a.s - b.s) > 0.01) = 0 AS passed FROM a JOIN b USING (o_orderstatus)""",
)
def _(t):
    other = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 0 OR o_orderstatus = 'F'")
    return suite(t, [r.tables_agree("other", ["o_orderstatus"], "o_totalprice", 0.01)], t.orders, {"other": other})


@query(
    "j20_schema_lock",
    """SELECT "column", change, severity, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES
         ('o_orderkey', 'became_nullable', 'fail'), ('o_custkey', 'widened', 'warn'), ('o_clerk', 'removed', 'fail'),
         ('o_orderstatus', 'narrowed', 'fail'), ('o_orderdate', 'added', 'warn'), ('o_orderpriority', 'added', 'warn')) v("column", change, severity)""",
)
def _(t):
    locked = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType(), False),
            T.StructField("o_custkey", T.IntegerType()),
            T.StructField("o_totalprice", T.DoubleType()),
            T.StructField("o_clerk", T.StringType()),
            T.StructField("o_orderstatus", T.LongType()),
        ]
    )
    rows = t.orders.agg(F.count(F.lit(1))).scalar()
    return r.schema_diff(t.orders, locked, ["o_orderkey", "o_clerk"]).withColumn("n_rows", rows)


@query(
    "j21_counts_and_sums",
    f"""SELECT 'row_count' AS rule, 'critical' AS criticality, count(*)::DOUBLE AS observed_value, count(*) BETWEEN 1000 AND 10000 AS passed FROM orders
        UNION ALL SELECT 'sum_matches:o_totalprice', 'critical', ({msum('o_totalprice')} - (SELECT {msum('l_extendedprice')} FROM lineitem))::DECIMAL(18,2)::DOUBLE,
               abs({msum('o_totalprice')} - (SELECT {msum('l_extendedprice')} FROM lineitem)) <= 0.01 FROM orders""",
)
def _(t):
    rules = [r.row_count(1000, 10000), r.sum_matches("o_totalprice", "lines", "l_extendedprice")]
    return suite(t, rules, tables={"lines": t.lineitem})


CONTRACT = """
tables:
  - name: orders
    columns:
      - {name: o_orderkey, type: BIGINT, required: true, primaryKey: true}
      - {name: o_orderstatus, type: VARCHAR(1), allowedValues: [F, O]}
      - {name: o_orderpriority, type: VARCHAR(20), pattern: "^[1-5]-"}
      - {name: o_totalprice, type: "DECIMAL(18,2)", minimum: 0}
    quality:
      schema:
        - {id: Q-1, type: uniqueness, severity: error, params: {columns: [o_orderkey]}}
        - {id: Q-2, type: not_null, severity: error, params: {columns: [o_custkey, o_orderdate]}}
      referential:
        - id: Q-3
          type: foreign_key
          severity: warn
          params: {childColumn: o_custkey, parentTable: gold.customer, parentColumn: c_custkey, ignoreNullChild: true}
          checks: {orphan_count_max: 0}
      distribution:
        - id: Q-4
          type: threshold_range
          severity: warn
          params: {column: o_totalprice, minValue: 5000, maxValue: 495000}
          checks: {outlier_pct_max: 0.5}
        - id: Q-5
          type: grouped_statistical_range
          severity: warn
          params:
            valueColumn: o_totalprice
            groupByColumn: o_orderstatus
            expectedRanges: {F: {minMean: 200000, maxMean: 300000, minRowsPerGroup: 100}}
      custom:
        - id: Q-6
          type: custom_sql
          severity: error
          params: {sql: "SELECT count(*) AS bad FROM {orders} WHERE o_totalprice > 499000"}
          checks: {failed_rows_max: 50}
"""

CONTRACT_SQL = " UNION ALL ".join(
    [
        row_sql("not_null:o_orderkey", "critical", "o_orderkey IS NULL", 0),
        row_sql("accepted:o_orderstatus", "critical", "o_orderstatus NOT IN ('F', 'O')", 0),
        row_sql("max_length:o_orderstatus", "critical", "length(o_orderstatus) > 1", 0),
        row_sql("pattern:o_orderpriority", "critical", "NOT regexp_matches(o_orderpriority, '^[1-5]-')", 0),
        row_sql("max_length:o_orderpriority", "critical", "length(o_orderpriority) > 20", 0),
        row_sql("range:o_totalprice", "critical", "o_totalprice < 0", 0),
        row_sql("not_null:o_custkey", "critical", "o_custkey IS NULL", 0),
        row_sql("not_null:o_orderdate", "critical", "o_orderdate IS NULL", 0),
        row_sql("range:o_totalprice", "important", "o_totalprice < 5000 OR o_totalprice > 495000", 0.5),
        "SELECT 'unique:o_orderkey', 'critical', (count(*) - count(DISTINCT o_orderkey))::DOUBLE, count(*) = count(DISTINCT o_orderkey) FROM orders",
        "SELECT 'unique:o_orderkey', 'critical', (count(*) - count(DISTINCT o_orderkey))::DOUBLE, count(*) = count(DISTINCT o_orderkey) FROM orders",
        "SELECT 'foreign_key:o_custkey', 'important', count(*)::DOUBLE, count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
        "SELECT 'group_mean:o_totalprice', 'important', (NOT (avg(o_totalprice) BETWEEN 200000 AND 300000 AND count(*) >= 100))::INT::DOUBLE, avg(o_totalprice) BETWEEN 200000 AND 300000 AND count(*) >= 100 FROM orders WHERE o_orderstatus = 'F'",
        "SELECT 'Q-6', 'critical', count(*)::DOUBLE, count(*) <= 50 FROM orders WHERE o_totalprice > 499000",
    ]
)


def contract_results(t):
    return r.run_suite({"orders": t.orders, "customer": t.customer}, contract.rules_from_contract(CONTRACT), NOW)


@query("j22_contract_rules", CONTRACT_SQL)
def _(t):
    return contract_results(t).select("rule", "criticality", "observed_value", "passed")


NESTED = """
spec:
  schema:
    table:
      schema: sales
      table: orders
      primaryKey: [o_orderkey]
      foreignKeys:
        - {column: o_custkey, references: sales.customer.c_custkey}
    columns:
      - {name: o_orderstatus, type: VARCHAR(1), required: true}
  quality:
    freshness:
      - id: F-1
        type: freshness
        severity: warn
        params: {timestampColumn: o_orderdate, loadedAtColumn: o_orderdate, toleranceMinutes: 90, percentagePass: 99}
        checks: {max_allowed_failed: 100}
      - id: F-2
        type: partition_availability
        severity: warn
        params: {partitionColumn: o_orderdate, readyByTime: "06:30:00", loadedAtColumn: o_orderdate, lookbackDays: 30, expectedMinRowsPerPartition: 1}
    schema:
      - id: S-1
        type: uniqueness
        severity: error
        params: {columns: [o_custkey]}
        checks: {duplicate_count_max: 10000000}
      - id: S-2
        type: not_null
        severity: error
        params: {columns: [o_orderpriority]}
        checks: {null_pct_per_column_max: 0.5}
    distribution:
      - id: D-1
        type: grouped_statistical_range
        severity: warn
        params:
          valueColumn: o_totalprice
          groupByColumn: o_orderstatus
          filterClause: "o_totalprice > 100000"
          expectedRanges: {F: {minMean: 200000, maxMean: 400000, minRowsPerGroup: 100}}
    custom:
      - id: C-1
        type: custom_sql
        severity: error
        params: {sql: "SELECT count(*) AS bad FROM orders JOIN customer c ON o_custkey = c.c_custkey WHERE orders.o_totalprice > 499000"}
        checks: {failed_rows_max: 50}
      - id: C-2
        type: custom_sql
        severity: warn
        params: {sql: "SELECT count(DISTINCT o_custkey) AS affected FROM sales.orders WHERE o_totalprice > 490000", entityColumn: o_custkey}
        checks: {affected_entity_pct_max: 20.0}
"""

NESTED_SQL = """
SELECT 'not_null:o_orderstatus' AS rule, 'critical' AS criticality, round(100.0 * count(*) FILTER (o_orderstatus IS NULL) / count(*), 6)::DOUBLE AS observed_value, count(*) = count(o_orderstatus) AS passed FROM orders
UNION ALL SELECT 'max_length:o_orderstatus', 'critical', round(100.0 * count(*) FILTER (length(o_orderstatus) > 1) / count(*), 6)::DOUBLE, count(*) FILTER (length(o_orderstatus) > 1) = 0 FROM orders
UNION ALL SELECT 'not_null:o_orderkey', 'critical', 0.0::DOUBLE, count(*) = count(o_orderkey) FROM orders
UNION ALL SELECT 'unique:o_orderkey', 'critical', (count(*) - count(DISTINCT o_orderkey))::DOUBLE, count(*) = count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'foreign_key:o_custkey', 'critical', count(*)::DOUBLE, count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'freshness:o_orderdate', 'important', 0.0::DOUBLE, true
UNION ALL SELECT 'partition_ready:o_orderdate', 'important', (30 - count(DISTINCT CAST(o_orderdate AS DATE)))::DOUBLE, count(DISTINCT CAST(o_orderdate AS DATE)) = 30 FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-01-31'
UNION ALL SELECT 'unique:o_custkey', 'critical', (count(*) - count(DISTINCT o_custkey))::DOUBLE, count(*) - count(DISTINCT o_custkey) <= 10000000 FROM orders
UNION ALL SELECT 'not_null:o_orderpriority', 'critical', round(100.0 * count(*) FILTER (o_orderpriority IS NULL) / count(*), 6)::DOUBLE, count(*) FILTER (o_orderpriority IS NULL) <= 0.005 * count(*) FROM orders
UNION ALL SELECT 'group_mean:o_totalprice', 'important', (NOT (avg(o_totalprice) BETWEEN 200000 AND 400000 AND count(*) >= 100))::INT::DOUBLE, avg(o_totalprice) BETWEEN 200000 AND 400000 AND count(*) >= 100 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
UNION ALL SELECT 'C-1', 'critical', count(*)::DOUBLE, count(*) <= 50 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 499000
UNION ALL SELECT 'C-2', 'important', (100.0 * count(DISTINCT o_custkey) FILTER (o_totalprice > 490000) / count(DISTINCT o_custkey))::DOUBLE, 100.0 * count(DISTINCT o_custkey) FILTER (o_totalprice > 490000) <= 20 * count(DISTINCT o_custkey) FROM orders
"""


@query("j22_contract_nested", NESTED_SQL)
def _(t):
    rules = contract.rules_from_contract(NESTED, "1996-01-01")
    return r.run_suite({"orders": t.orders, "customer": t.customer}, rules, NOW).select("rule", "criticality", "observed_value", "passed")


@query("j23_results_table", f"SELECT rule, passed, TIMESTAMP '2024-02-01' AS checked_at, 'orders' AS \"table\" FROM ({CONTRACT_SQL})")
def _(t):
    path = new_path(t.spark, "dq_results")
    contract_results(t).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).select("rule", "passed", "checked_at", "table")


@query(
    "j24_publish_gate",
    f"""SELECT count(*) FILTER (NOT passed AND criticality = 'critical') AS n_block, count(*) FILTER (NOT passed AND criticality = 'important') AS n_warn,
               CASE WHEN count(*) FILTER (NOT passed AND criticality = 'critical') > 0 THEN 'blocked' WHEN count(*) FILTER (NOT passed AND criticality = 'important') > 0 THEN 'published_with_warnings' ELSE 'published' END AS decision
        FROM ({CONTRACT_SQL})""",
)
def _(t):
    return r.decide(contract_results(t), {"critical": "block", "important": "warn", "informational": "ignore"})


BROKEN = """concat_ws(',', CASE WHEN NOT (l_shipdate >= o_orderdate) THEN 'ships_after_order' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'accepted:l_returnflag' END,
   CASE WHEN NOT (l_quantity BETWEEN 2 AND 49) THEN 'range:l_quantity' END)"""


def line_rules():
    return [
        r.invariant("ships_after_order", F.col("l_shipdate") >= F.col("o_orderdate")),
        r.accepted("l_returnflag", ["A", "N"]),
        r.in_range("l_quantity", 2, 49),
    ]


@query(
    "j25_quarantine",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {BROKEN} AS failed FROM {LINES} WHERE {BROKEN} <> ''""",
)
def _(t):
    _, bad = r.quarantine(lines(t), line_rules())
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("failed_rules", ",").alias("failed"))


@query("j25_quarantine_good", f"SELECT l_orderkey, l_linenumber, l_partkey FROM {LINES} WHERE {BROKEN} = ''")
def _(t):
    good, _ = r.quarantine(lines(t), line_rules())
    return good.select("l_orderkey", "l_linenumber", "l_partkey")


RESULTS = "(SELECT ts AS checked_at, event_type AS rule, CASE WHEN event_type IN ('error', 'purchase') THEN 'critical' ELSE 'important' END AS criticality, value < 15 AS passed FROM events)"


def results(t):
    """Events read as check results: one check per event, passing below 15."""
    crit = F.when(F.col("event_type").isin("error", "purchase"), "critical").otherwise("important")
    return t.events.select(
        F.col("ts").alias("checked_at"), F.col("event_type").alias("rule"), crit.alias("criticality"), (F.col("value") < 15).alias("passed")
    )


@query(
    "j26_suite_trend",
    f"""SELECT CAST(checked_at AS DATE) AS day, criticality, count(*) AS n_checks, count(*) FILTER (passed) AS n_passed,
               round(100.0 * count(*) FILTER (passed) / count(*), 6)::DOUBLE AS pass_pct FROM {RESULTS} GROUP BY ALL""",
)
def _(t):
    return r.dq_dashboard(results(t))


@query(
    "j26_top_failing",
    f"SELECT rule, count(*) AS n_failed FROM {RESULTS} WHERE NOT passed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def _(t):
    return r.top_failing(results(t), ["rule"], 3)


@query(
    "j26_time_to_repair",
    f"""WITH p AS (SELECT *, lag(passed) OVER (PARTITION BY rule ORDER BY checked_at) AS was FROM {RESULTS}),
             e AS (SELECT rule, checked_at, passed FROM p WHERE (was IS NULL AND NOT passed) OR was <> passed),
             n AS (SELECT *, lead(checked_at) OVER (PARTITION BY rule ORDER BY checked_at) AS repaired_at FROM e)
        SELECT rule, checked_at AS failed_at, repaired_at, round((epoch_us(repaired_at) - epoch_us(checked_at)) / 3.6e9, 6) AS hours FROM n WHERE NOT passed""",
)
def _(t):
    out = r.time_to_repair(results(t), ["rule"])
    return out.withColumn("hours", F.round("hours", 6))


@query(
    "j27_slo",
    f"""WITH d AS (SELECT CAST(checked_at AS DATE) AS day, count(*) FILTER (passed) AS p, count(*) AS n FROM {RESULTS} GROUP BY 1),
             w AS (SELECT day, round(100.0 * sum(p) OVER (ORDER BY day ROWS 6 PRECEDING) / sum(n) OVER (ORDER BY day ROWS 6 PRECEDING), 6)::DOUBLE AS pass_pct FROM d)
        SELECT day, pass_pct, CASE WHEN pass_pct < 77 THEN 'breach' WHEN pass_pct < 78 THEN 'warning' ELSE 'ok' END AS status FROM w""",
)
def _(t):
    return r.slo(results(t), 77, 78, 7)
