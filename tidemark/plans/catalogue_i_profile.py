"""Profiling."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import profile as pf
from tidemark.plans.registry import query
from tidemark.plans.sqltext import union

PRIO = "nullif(o_orderpriority, '5-LOW')"
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def holed(t):
    """Orders with NULL where the priority is the lowest and blank where the status is P."""
    return t.orders.withColumns(
        {
            "o_orderpriority": fx.nullify("o_orderpriority", ["5-LOW"]),
            "o_orderstatus": F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")),
        }
    )


HOLED = f"""h AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate, {PRIO} AS o_orderpriority FROM orders)"""
KINDS = dict(zip(ORDER_COLS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"], strict=True))
PROFILE_SQL = f"WITH {HOLED}, p AS (" + union(
    f"""SELECT '{c}' AS "column", '{KINDS[c]}' AS dtype, count(*) AS total_rows, count({c}) AS non_null, count(*) - count({c}) AS nulls,
        round(count({c})::DOUBLE / count(*), 6) AS completeness, count(DISTINCT {c}) AS unique_count,
        round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS unique_ratio FROM h"""
    for c in ORDER_COLS
) + ")"


@query("i1_profile", PROFILE_SQL + " SELECT * FROM p")
def _(t):
    return pf.profile(holed(t))


@query(
    "i2_completeness",
    PROFILE_SQL + """ SELECT 'warn' AS severity, 'completeness_below_threshold' AS rule, "column" FROM p WHERE completeness < 0.7""",
)
def _(t):
    return pf.check_completeness(pf.profile(holed(t))).select("severity", "rule", "column")


@query(
    "i3_pk_candidates",
    PROFILE_SQL + """ SELECT 'info' AS severity, 'pk_candidate' AS rule, "column" FROM p WHERE unique_ratio >= 0.999 AND total_rows > 1 AND nulls = 0""",
)
def _(t):
    return pf.pk_candidates(pf.profile(holed(t))).select("severity", "rule", "column")


NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "i4_numeric_summary",
    union(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, max({c}) AS max,
            round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""
        for c in NUMS
    ),
)
def _(t):
    out = pf.describe_numeric(t.lineitem, NUMS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "q25", "q50", "q75")} | {"std": F.round("std", 5)})


@query(
    "i5_iqr_outliers",
    """WITH r AS (SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS v FROM lineitem GROUP BY l_orderkey),
            q AS (SELECT quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM r)
       SELECT 'v' AS "column", round(q25 - 1.5 * (q75 - q25), 4) AS lower, round(q75 + 1.5 * (q75 - q25), 4) AS upper,
              count(*) FILTER (v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25)) AS n_outliers FROM r, q GROUP BY ALL""",
)
def _(t):
    r = t.lineitem.groupBy("l_orderkey").agg(fx.money_sum("l_extendedprice").alias("v"))
    out = pf.iqr_outliers(r, ["v"])
    return out.withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4)})


@query(
    "i6_timestamp_gaps",
    """WITH d AS (SELECT DISTINCT user_id, ts FROM events), n AS (SELECT user_id, ts AS gap_start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap_end FROM d)
       SELECT user_id, gap_start, gap_end, round((epoch_us(gap_end) - epoch_us(gap_start)) / 3.6e9, 6) AS gap_hours FROM n
       WHERE (epoch_us(gap_end) - epoch_us(gap_start)) / 3.6e9 > 24""",
)
def _(t):
    out = pf.ts_gaps(t.events, "ts", 24, by=["user_id"])
    return out.select("user_id", "gap_start", "gap_end", F.round("gap_hours", 6).alias("gap_hours"))


@query(
    "i6_table_gaps",
    """WITH d AS (SELECT DISTINCT ts FROM events), n AS (SELECT ts AS gap_start, lead(ts) OVER (ORDER BY ts) AS gap_end FROM d)
       SELECT gap_start, gap_end, round((epoch_us(gap_end) - epoch_us(gap_start)) / 3.6e9, 6) AS gap_hours FROM n
       WHERE (epoch_us(gap_end) - epoch_us(gap_start)) / 3.6e9 > 0.3""",
)
def _(t):
    out = pf.ts_gaps(t.events, "ts", 0.3)
    return out.select("gap_start", "gap_end", F.round("gap_hours", 6).alias("gap_hours"))


@query(
    "i7_duplicate_rows",
    """WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM d""",
)
def _(t):
    return pf.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query(
    "i8_primary_key",
    """SELECT 'l_orderkey,l_linenumber' AS key, NULL::VARCHAR AS missing, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, sum(n - 1) = 0 AS is_unique
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       UNION ALL SELECT 'o_orderkey', NULL, CAST(sum(n - 1) AS BIGINT), sum(n - 1) = 0 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
       UNION ALL SELECT 'o_orderkey,o_region', 'o_region', NULL, false""",
)
def _(t):
    a = pf.check_pk(t.lineitem, ["l_orderkey", "l_linenumber"])
    return a.unionByName(pf.check_pk(t.orders, ["o_orderkey"])).unionByName(pf.check_pk(t.orders, ["o_orderkey", "o_region"]))


@query(
    "i9_range_check",
    """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 5) AS n_below, count(*) FILTER (l_quantity > 45) AS n_above FROM lineitem
       UNION ALL SELECT 'l_returnflag', 0, 0 UNION ALL SELECT 'l_tax', 0, count(*) FILTER (l_tax > 0.07) FROM lineitem""",
)
def _(t):
    return pf.check_range(t.lineitem, {"l_quantity": (5, 45), "l_returnflag": (0, 1), "l_tax": (None, 0.07)})


def _outliers(column):
    return f"""SELECT 'warn' AS severity, 'numeric_outliers' AS rule, '{column}' AS "column" FROM h, (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM h) q
        HAVING count(*) FILTER ({column} < a - 1.5 * (b - a) OR {column} > b + 1.5 * (b - a)) > 0"""


ISSUES_SQL = PROFILE_SQL + ", i AS (" + union(
    [
        """SELECT 'warn' AS severity, 'completeness_below_threshold' AS rule, "column" FROM p WHERE completeness < 0.7""",
        """SELECT 'info', 'pk_candidate', "column" FROM p WHERE unique_ratio >= 0.999 AND total_rows > 1 AND nulls = 0""",
        *[_outliers(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")],
        """SELECT 'warn', 'datetime_gap', 'o_orderdate' FROM (SELECT o_orderdate AS a, lead(o_orderdate) OVER (ORDER BY o_orderdate) AS b FROM h) g HAVING count(*) FILTER (b - a > INTERVAL 12 HOUR) > 0""",
        "SELECT 'warn', 'duplicate_rows', NULL FROM h HAVING count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM h) u)",
        "SELECT 'error', 'pk_not_unique', 'o_custkey' FROM h HAVING count(*) > count(DISTINCT o_custkey)",
        "SELECT 'warn', 'range_violation', 'o_totalprice' FROM h HAVING count(*) FILTER (o_totalprice > 400000 OR o_totalprice < 0) > 0",
        "SELECT 'error', 'range_column_missing', 'o_region'",
        "SELECT 'error', 'range_config_error', 'o_orderkey'",
    ]
) + ")"


def all_issues(t):
    ranges = {"o_totalprice": (0, 400000), "o_region": (0, 1), "o_orderkey": ("low", 1)}
    return pf.issues(holed(t), ranges, key=["o_custkey"], gap_hours=12)


@query("i10_issues", ISSUES_SQL + " SELECT * FROM i")
def _(t):
    return all_issues(t).select("severity", "rule", "column")


@query(
    "i10_gate",
    ISSUES_SQL
    + """ SELECT count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn,
             count(*) FILTER (severity = 'info') AS n_info, count(*) FILTER (severity = 'error') = 0 AS passed FROM i""",
)
def _(t):
    return pf.gate(all_issues(t))


@query(
    "i11_type_inference",
    """WITH m AS (SELECT count(*) AS n, count(*) FILTER (o_orderpriority <> '5-LOW') AS k FROM orders)
       SELECT 'price_text' AS "column", n AS n_values, n AS n_numeric, 0::BIGINT AS n_datetime, 'numeric' AS inferred FROM m
       UNION ALL SELECT 'order_dt', n, 0, n, 'datetime' FROM m UNION ALL SELECT 'status', n, 0, 0, 'text' FROM m
       UNION ALL SELECT 'mixed', n, k, 0, CASE WHEN k >= 0.95 * n THEN 'numeric' ELSE 'text' END FROM m""",
)
def _(t):
    text = t.orders.select(
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_dt"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.col("o_orderstatus").alias("status"),
    )
    return pf.infer_types(text)


@query(
    "i12_table_summary",
    """SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS n_distinct,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS n_duplicates, 5 AS n_columns FROM customer""",
)
def _(t):
    return pf.table_summary(t.customer)


def _volume(unit):
    return f"""c AS (SELECT date_trunc('{unit}', ts) AS period, count(*) AS n FROM events GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(period) FROM c), (SELECT max(period) FROM c), INTERVAL 1 {unit})) AS period),
  v AS (SELECT period, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'gap' WHEN n > 2 * (SELECT median(n) FROM c) THEN 'spike' ELSE 'ok' END AS flag
        FROM s LEFT JOIN c USING (period))"""


@query("i13_volume_by_period", f"WITH {_volume('hour')} SELECT * FROM v")
def _(t):
    return pf.volume_by_period(t.events, "ts", "hour", spike=2)


@query("i14_missing_periods", f"WITH {_volume('minute')} SELECT period FROM v WHERE n = 0")
def _(t):
    return pf.missing_periods(t.events, "ts", "minute")


@query(
    "i15_quantiles",
    union(
        f"""SELECT '{c}' AS "column", """ + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM lineitem"
        for c in NUMS
    ),
)
def _(t):
    out = pf.quantiles(t.lineitem, NUMS)
    return out.select("column", *[F.round(c, 6).alias(c) for c in out.columns if c != "column"])


@query(
    "i16_sentinel_scan",
    """SELECT 'o_orderpriority' AS "column", '4-NOT SPECIFIED' AS sentinel, count(*) AS n FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
       UNION ALL SELECT 'o_custkey', '999', count(*) FROM orders WHERE o_custkey = 999
       UNION ALL SELECT 'o_orderkey', '999', count(*) FROM orders WHERE o_orderkey = 999""",
)
def _(t):
    return pf.sentinel_scan(t.orders, ["4-NOT SPECIFIED", 999, "N/A", ""])


LINE_COLS = ["l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]


@query(
    "i17_grain_check",
    "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, "
    + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in LINE_COLS)
    + " FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) "
    + union(
        f"""SELECT count(*) AS duplicate_groups, '{c}' AS "column", count(*) FILTER ({c} > 1) AS groups_differing FROM g""" for c in LINE_COLS
    ),
)
def _(t):
    return pf.grain_check(t.lineitem.select("l_orderkey", "l_linenumber", *LINE_COLS), ["l_orderkey", "l_linenumber"])


@query(
    "i18_duplicate_causes",
    """WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n, count(DISTINCT l_linestatus) AS a, count(DISTINCT l_shipdate) AS d FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT CASE WHEN a = 1 AND d = 1 THEN 'exact_copy' WHEN a = 1 THEN 're_processed' ELSE 'grain_mismatch' END AS cause, count(*) AS n_groups,
              CAST(sum(n - 1) AS BIGINT) AS n_excess, round(sum(n - 1)::DOUBLE / (SELECT count(*) FROM lineitem), 8) AS excess_rate FROM g GROUP BY 1""",
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    out = pf.classify_duplicates(df, ["l_orderkey", "l_returnflag"], "l_shipdate")
    return out.withColumn("excess_rate", F.round("excess_rate", 8))


FREE = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "i19_find_keys",
    "WITH d AS ("
    + union(f"SELECT '{c}' AS key, count(DISTINCT {c}) = count(*) AS ok FROM customer" for c in FREE)
    + "), p AS ("
    + union(
        f"SELECT '{a},{b}' AS key, '{a}' AS a, '{b}' AS b, count(DISTINCT ({a}, {b})) = count(*) AS ok FROM customer"
        for i, a in enumerate(FREE) for b in FREE[i + 1 :]
    )
    + """) SELECT key, 1 AS n_columns FROM d WHERE ok
           UNION ALL SELECT key, 2 FROM p WHERE ok AND a NOT IN (SELECT key FROM d WHERE ok) AND b NOT IN (SELECT key FROM d WHERE ok)""",
)
def _(t):
    return pf.find_keys(t.customer.drop("c_name"))


@query(
    "i20_null_report",
    PROFILE_SQL + """ SELECT "column", nulls, round(1 - completeness, 6) AS null_share, round(1 - completeness, 6) > 0.05 AS is_risk FROM p""",
)
def _(t):
    return pf.null_report(holed(t))


@query(
    "i21_freshness",
    "SELECT max(ts) AS newest, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9, 6) AS lag_hours FROM events",
)
def _(t):
    return pf.freshness(t.events, "ts", "2024-02-01 00:00:00").withColumn("lag_hours", F.round("lag_hours", 6))


def _cat(c):
    return f"""SELECT '{c}' AS "column", count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_values, min_by(v, rk) AS top_value,
        round(sum(n) FILTER (rk <= 10)::DOUBLE / sum(n), 8) AS top_share, round(coalesce(sum(n) FILTER (rk > 10), 0)::DOUBLE / sum(n), 8) AS tail_share
        FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk FROM part GROUP BY 1)"""


@query("i22_categorical_profile", union(_cat(c) for c in ("p_brand", "p_type", "p_name")))
def _(t):
    out = pf.profile_categorical(t.part, ["p_brand", "p_type", "p_name"])
    return out.withColumns({"top_share": F.round("top_share", 8), "tail_share": F.round("tail_share", 8)})


@query(
    "i23_histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n,
              round(any_value(lo) + least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) * any_value((hi - lo) / 20), 6) AS bin_start
       FROM orders, e GROUP BY least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)""",
)
def _(t):
    return pf.histogram(t.orders, "o_totalprice", 20).withColumn("bin_start", F.round("bin_start", 6))
