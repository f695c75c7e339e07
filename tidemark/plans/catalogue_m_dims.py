"""Dimensional modelling."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import dims as dm
from tidemark.plans.catalogue_c_joins import customer_versions
from tidemark.plans.registry import query
from tidemark.plans.sqltext import msum

LOAD = "2024-03-01 00:00:00"
CUST = ["c_mktsegment", "c_nationkey"]


def old_dim(t):
    """Customer dimension before the load: members with a balance up to 9000."""
    return t.customer.filter("c_acctbal <= 9000").select("c_custkey", *CUST)


def source(t):
    """Today's source: indebted customers changed segment, the most indebted are gone."""
    seg = F.when(F.col("c_acctbal") < 0, "MOVED").otherwise(F.col("c_mktsegment"))
    return t.customer.filter("c_acctbal > -900").select("c_custkey", seg.alias("c_mktsegment"), "c_nationkey")


PAIR = """d AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_acctbal <= 9000),
  s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > -900),
  j AS (SELECT coalesce(d.c_custkey, s.c_custkey) AS c_custkey, d.c_custkey IS NOT NULL AS had, s.c_custkey IS NOT NULL AS has, d.c_mktsegment AS dseg, s.c_mktsegment AS sseg,
               d.c_nationkey AS dn, s.c_nationkey AS sn FROM d FULL JOIN s ON d.c_custkey = s.c_custkey)"""


def date_bounds(t):
    return t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))


@query(
    "m1_dim_date",
    """WITH d AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date),
            f AS (SELECT date, date + INTERVAL 9 MONTH AS fd FROM d)
       SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, CAST(isodow(date) AS INTEGER) AS day_of_week, dayname(date) AS day_name, CAST(day(date) AS INTEGER) AS day_of_month,
              CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(isoyear(date) * 100 + week(date) AS INTEGER) AS week_key, CAST(week(date) AS INTEGER) AS iso_week_of_year,
              CAST(year(date) * 100 + month(date) AS INTEGER) AS month_key, strftime(date, '%b') AS month_name_short, monthname(date) AS month_name, CAST(year(date) * 10 + quarter(date) AS INTEGER) AS quarter_key,
              'Q' || quarter(date) AS quarter_name, CAST(year(date) AS INTEGER) AS year, CAST(year(fd) AS INTEGER) AS fiscal_year, CAST(quarter(fd) AS INTEGER) AS fiscal_quarter,
              'FY' || year(fd) || '-P' || lpad(CAST(month(fd) AS VARCHAR), 2, '0') AS fiscal_period, isodow(date) >= 6 AS is_weekend, date IN (DATE '1996-12-25', DATE '1997-01-01') AS is_holiday,
              isodow(date) < 6 AND date NOT IN (DATE '1996-12-25', DATE '1997-01-01') AS is_working_day, CAST(date_diff('day', DATE '1998-01-01', date) AS INTEGER) AS relative_days FROM f""",
)
def _(t):
    return dm.dim_date(date_bounds(t), "a", "b", 4, ["1996-12-25", "1997-01-01"], "1998-01-01")


@query(
    "m2_dim_time",
    """WITH d AS (SELECT i AS time_key, CAST(i // 60 AS INTEGER) AS hour, CAST(i % 60 AS INTEGER) AS minute FROM range(1440) r(i))
       SELECT time_key, hour, minute, CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS day_part, count(event_id) AS n
       FROM d LEFT JOIN events ON hour(ts) * 60 + minute(ts) = time_key GROUP BY ALL""",
)
def _(t):
    at = (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("time_key")
    counts = t.events.groupBy(at).agg(F.count("*").alias("n"))
    out = dm.dim_time(t.spark, "minute").join(counts, "time_key", "left").fillna(0, ["n"])
    return out.select("time_key", "hour", "minute", "day_part", "n")


@query(
    "m3_assign_keys",
    """WITH e AS (SELECT c_custkey, 100 + row_number() OVER (ORDER BY c_custkey) AS customer_sk FROM customer WHERE c_acctbal > 5000)
       SELECT c_custkey, CAST(customer_sk AS BIGINT) AS customer_sk FROM e UNION ALL
       SELECT c_custkey, CAST((SELECT max(customer_sk) FROM e) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) FROM customer WHERE NOT (c_acctbal > 5000)""",
)
def _(t):
    rich = t.customer.filter("c_acctbal > 5000").select("c_custkey")
    existing = dm.number_rows(rich, ["c_custkey"], "customer_sk", 101)
    return dm.assign_keys(t.customer, existing, ["c_custkey"], "customer_sk")


@query(
    "m3_assign_text_keys",
    """SELECT count(*) AS n_keys, count(DISTINCT p_brand) AS n_brands, CAST(min(k) AS BIGINT) AS lo, CAST(max(k) AS BIGINT) AS hi, count(DISTINCT k) AS n_distinct
       FROM (SELECT p_brand, row_number() OVER () AS k FROM (SELECT DISTINCT p_brand FROM part))""",
)
def _(t):
    none = t.spark.createDataFrame([], "p_brand string, brand_sk long")
    keys = dm.assign_keys(t.part, none, ["p_brand"], "brand_sk")
    return keys.agg(
        F.count("*").alias("n_keys"), F.count_distinct("p_brand").alias("n_brands"), F.min("brand_sk").alias("lo"),
        F.max("brand_sk").alias("hi"), F.count_distinct("brand_sk").alias("n_distinct"),
    )


@query("m4_hash_keys", "SELECT l_orderkey, l_linenumber, md5(l_orderkey || '|' || l_linenumber) AS line_key FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", fx.hash_key(["l_orderkey", "l_linenumber"]).alias("line_key"))


@query(
    "m5_unknown_member",
    f"""SELECT seg, count(*) AS n, {msum('o_totalprice')} AS revenue FROM (
          SELECT CASE WHEN c_acctbal <= 9000 THEN c_mktsegment ELSE 'Unknown' END AS seg, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
)
def _(t):
    dim = dm.with_unknown(old_dim(t).withColumn("sk", F.col("c_custkey") + 1), "sk")
    fact = dm.resolve_fk(t.orders, "o_custkey", dim.filter("sk <> -1"), "c_custkey", "sk")
    out = fact.join(dim, F.col("o_custkey_key") == F.col("sk"))
    return out.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"), fx.money_sum("o_totalprice").alias("revenue"))


@query("m6_scd0", f"WITH {PAIR} SELECT c_custkey, coalesce(dseg, sseg) AS c_mktsegment, coalesce(dn, sn) AS c_nationkey FROM j")
def _(t):
    return dm.scd0(old_dim(t), source(t), "c_custkey")


@query(
    "m6_scd1",
    f"""WITH {PAIR} SELECT c_custkey, coalesce(sseg, dseg) AS c_mktsegment, coalesce(sn, dn) AS c_nationkey, CASE WHEN had THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '{LOAD}' END AS created_at,
              CASE WHEN NOT had OR dseg <> sseg THEN TIMESTAMP '{LOAD}' ELSE TIMESTAMP '2020-01-01' END AS updated_at FROM j""",
)
def _(t):
    then = F.lit("2020-01-01").cast("timestamp_ntz")
    return dm.scd1(old_dim(t).withColumns({"created_at": then, "updated_at": then}), source(t), "c_custkey", CUST, LOAD)


def dim2(t):
    """A type 2 customer dimension with one closed version per indebted member."""
    start, mid = F.lit("2020-01-01").cast("timestamp_ntz"), F.lit("2022-01-01").cast("timestamp_ntz")
    live = old_dim(t).select(
        "c_custkey", *CUST, F.when(F.col("c_mktsegment") == "BUILDING", mid).otherwise(start).alias(dm.FROM),
        F.lit(None).cast("timestamp_ntz").alias(dm.TO), F.lit(True).alias(dm.CURRENT),
    )
    past = old_dim(t).filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.lit("OLD").alias("c_mktsegment"), "c_nationkey", start.alias(dm.FROM), mid.alias(dm.TO), F.lit(False).alias(dm.CURRENT)
    )
    return live.unionByName(past)


DIM2_AFTER = f"""{PAIR}, a AS (
  SELECT c_custkey, 'OLD' AS c_mktsegment, dn AS c_nationkey, TIMESTAMP '2020-01-01' AS row_effective_from, TIMESTAMP '2022-01-01' AS row_effective_to, false AS is_current FROM j WHERE had AND dseg = 'BUILDING'
  UNION ALL SELECT c_custkey, dseg, dn, CASE WHEN dseg = 'BUILDING' THEN TIMESTAMP '2022-01-01' ELSE TIMESTAMP '2020-01-01' END, CASE WHEN has AND dseg <> sseg THEN TIMESTAMP '{LOAD}' END, NOT (has AND dseg <> sseg) FROM j WHERE had
  UNION ALL SELECT c_custkey, sseg, sn, TIMESTAMP '{LOAD}', NULL, true FROM j WHERE has AND (NOT had OR dseg <> sseg))"""


def dim2_after(t):
    return dm.scd2(dim2(t), source(t), "c_custkey", CUST, LOAD)


@query("m7_scd2", f"WITH {DIM2_AFTER} SELECT * FROM a")
def _(t):
    return dim2_after(t)


@query("m7_scd2_rerun", f"WITH {DIM2_AFTER} SELECT * FROM a")
def _(t):
    return dm.scd2(dim2_after(t), source(t), "c_custkey", CUST, "2024-03-02 00:00:00")


HISTORY = """l AS (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1, 2),
  c AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS was FROM l),
  v AS (SELECT o_custkey, o_orderpriority, o_orderdate AS row_effective_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS row_effective_to FROM c WHERE was IS NULL OR was <> o_orderpriority)"""


def history(t):
    return dm.scd2_from_history(t.orders.select("o_custkey", "o_orderpriority", "o_orderdate"), "o_custkey", ["o_orderpriority"], "o_orderdate")


@query("m8_scd2_from_history", f"WITH {HISTORY} SELECT *, row_effective_to IS NULL AS is_current FROM v")
def _(t):
    return history(t)


@query(
    "m9_scd3",
    f"WITH {PAIR} SELECT c_custkey, coalesce(sseg, dseg) AS c_mktsegment, CASE WHEN had AND has AND dseg <> sseg THEN dseg END AS previous_c_mktsegment FROM j",
)
def _(t):
    return dm.scd3(old_dim(t), source(t), "c_custkey", "c_mktsegment")


@query(
    "m10_scd4",
    f"""WITH {PAIR} SELECT 'current' AS part, c_custkey, coalesce(sseg, dseg) AS c_mktsegment FROM j
        UNION ALL SELECT 'history', c_custkey, dseg FROM j WHERE had AND has AND dseg <> sseg""",
)
def _(t):
    cur, old = dm.scd4(old_dim(t), source(t), "c_custkey", CUST, LOAD)
    a = cur.select(F.lit("current").alias("part"), "c_custkey", "c_mktsegment")
    return a.unionByName(old.select(F.lit("history").alias("part"), "c_custkey", "c_mktsegment"))


@query(
    "m11_scd6",
    f"""WITH {DIM2_AFTER} SELECT c_custkey, c_mktsegment, row_effective_from, lag(c_mktsegment) OVER (PARTITION BY c_custkey ORDER BY row_effective_from) AS previous_c_mktsegment,
              max(c_mktsegment) FILTER (is_current) OVER (PARTITION BY c_custkey) AS current_c_mktsegment FROM a""",
)
def _(t):
    out = dm.scd6(dim2_after(t), "c_custkey", ["c_mktsegment"])
    return out.select("c_custkey", "c_mktsegment", dm.FROM, "previous_c_mktsegment", "current_c_mktsegment")


@query(
    "m12_scd2_integrity",
    f"""WITH {HISTORY}, b AS (SELECT o_custkey, o_orderpriority, row_effective_from, CASE WHEN o_orderpriority = '1-URGENT' THEN row_effective_to - INTERVAL 1 DAY WHEN o_orderpriority = '2-HIGH' THEN row_effective_to + INTERVAL 1 DAY ELSE row_effective_to END AS rt FROM v),
             n AS (SELECT *, lead(row_effective_from) OVER (PARTITION BY o_custkey ORDER BY row_effective_from) AS nx FROM b),
             g AS (SELECT o_custkey, count(*) FILTER (nx > rt) AS n_gaps, count(*) FILTER (nx < rt OR (rt IS NULL AND nx IS NOT NULL)) AS n_overlaps, count(*) FILTER (rt IS NULL) AS n_current FROM n GROUP BY 1)
        SELECT * FROM g WHERE n_gaps > 0 OR n_overlaps > 0 OR n_current <> 1""",
)
def _(t):
    p, end = F.col("o_orderpriority"), F.col(dm.TO)
    shifted = F.when(p == "1-URGENT", end - F.expr("INTERVAL 1 DAY")).when(p == "2-HIGH", end + F.expr("INTERVAL 1 DAY")).otherwise(end)
    return dm.check_scd2(history(t).withColumn(dm.TO, shifted), "o_custkey")


@query(
    "m13_star_fact",
    """WITH v AS (SELECT o_custkey AS bk, o_orderdate AS vf, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS vt FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders))
       SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p.p_partkey, -1) AS l_partkey_key, coalesce(v.bk || ':' || strftime(v.vf, '%Y%m%d'), '-1') AS o_custkey_version_key,
              CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS date_key, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON l_partkey = p.p_partkey
       LEFT JOIN v ON v.bk = o_custkey AND l_shipdate >= vf AND (vt IS NULL OR l_shipdate < vt)""",
)
def _(t):
    part = t.part.filter("p_size > 10").select("p_partkey", F.col("p_partkey").alias("part_sk"))
    vers = customer_versions(t).withColumn("version_sk", F.concat_ws(":", F.col("bk").cast("string"), fx.date_key(dm.FROM).cast("string")))
    out = dm.build_fact(
        t.order_lines, {"l_partkey": (part, "p_partkey", "part_sk")}, {"o_custkey": (vers, "bk", "version_sk")}, "l_shipdate",
        ["l_orderkey", "l_linenumber", "l_partkey"], {"amount": fx.money("l_extendedprice")},
    )
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "m14_periodic_snapshot",
    """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS moved FROM lineitem GROUP BY 1, 2),
            s AS (SELECT l_suppkey, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), (SELECT CAST(max(day) AS TIMESTAMP) FROM d), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
       SELECT l_suppkey, day, coalesce(moved, 0) AS moved, CAST(sum(coalesce(moved, 0)) OVER (PARTITION BY l_suppkey ORDER BY day) AS BIGINT) AS balance FROM s LEFT JOIN d USING (l_suppkey, day)""",
)
def _(t):
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    return dm.periodic_snapshot(t.lineitem, "l_suppkey", "l_shipdate", qty)


STEPS = ["signup", "view", "purchase"]


@query(
    "m15_accumulating_snapshot",
    """WITH a AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signup_at, min(ts) FILTER (event_type = 'view') AS view_at, min(ts) FILTER (event_type = 'purchase') AS purchase_at FROM events GROUP BY 1)
       SELECT *, CAST(date_diff('day', signup_at, view_at) AS INTEGER) AS days_signup_to_view, CAST(date_diff('day', view_at, purchase_at) AS INTEGER) AS days_view_to_purchase,
              CASE WHEN purchase_at IS NOT NULL THEN 'purchase' WHEN view_at IS NOT NULL THEN 'view' WHEN signup_at IS NOT NULL THEN 'signup' ELSE 'none' END AS status FROM a""",
)
def _(t):
    return dm.accumulating_snapshot(t.events, "user_id", "event_type", "ts", STEPS)


@query(
    "m16_factless_coverage",
    """SELECT c_mktsegment, c_nationkey FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)
       EXCEPT SELECT c_mktsegment, c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 480000""",
)
def _(t):
    big = t.orders.filter("o_totalprice > 480000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    keys = ["c_mktsegment", "c_nationkey"]
    return dm.did_not_happen(t.customer, dm.factless(big, keys), keys)


@query(
    "m17_allocated_bridge",
    """WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM b)
       SELECT l_suppkey, round(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1.0::DOUBLE / c AS DECIMAL(9,8)))::DOUBLE, 4) AS allocated FROM n JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    from tidemark.operators.windows import group_transform

    pairs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    bridge = group_transform(pairs, ["o_orderkey"], "l_suppkey", "count", "c").withColumn("w", 1.0 / F.col("c"))
    out = dm.allocate(t.orders, bridge, "o_orderkey", "o_totalprice", "w")
    return out.groupBy("l_suppkey").agg(F.round(F.sum("allocated").cast("double"), 4).alias("allocated"))


@query(
    "m18_junk_dimension",
    """SELECT md5(l_returnflag || '|' || l_linestatus) AS junk_key, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(t):
    dim, fact = dm.junk_dim(t.lineitem, ["l_returnflag", "l_linestatus"])
    counts = fact.groupBy("junk_key").agg(F.count("*").alias("n"))
    return dim.join(counts, "junk_key")


@query(
    "m19_role_playing_dates",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, 'Q' || quarter(l_shipdate) AS ship_quarter_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def _(t):
    bounds = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).unionByName(
        t.lineitem.agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    )
    dates = dm.dim_date(bounds.agg(F.min("a").alias("a"), F.max("b").alias("b")), "a", "b")
    fact = t.order_lines.select(
        fx.date_key("o_orderdate").alias("ok"), fx.date_key("l_shipdate").alias("sk")
    )
    out = dm.role_play(fact, dates, {"order": "ok", "ship": "sk"}, ["year", "quarter_name"])
    return out.groupBy("order_year", "ship_quarter_name").agg(F.count("*").alias("n"))


@query(
    "m20_degenerate_key",
    "SELECT l_shipdate, count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_lines FROM lineitem GROUP BY 1",
)
def _(t):
    fact = t.lineitem.select("l_orderkey", "l_shipdate")
    return fact.groupBy("l_shipdate").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count("*").alias("n_lines"))


@query(
    "m21_flattened_dimension",
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    out = dm.flatten_dim(t.customer, [(t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")])
    return out.select("c_custkey", "n_name", "r_name")


@query(
    "m22_semi_additive",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS bal FROM events GROUP BY 1, 2),
            l AS (SELECT user_id, CAST(date_trunc('week', day) AS DATE) AS week, arg_max(bal, day) AS v FROM d GROUP BY 1, 2)
       SELECT week, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS closing FROM l GROUP BY 1""",
)
def _(t):
    daily = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum(fx.money("value")).alias("bal"))
    out = dm.semi_additive(daily, ["user_id"], "day", "bal", {"week": fx.period("day", "week")})
    return out.withColumn("closing", F.col("closing").cast("double"))


@query(
    "m23_inferred_members",
    """SELECT c_custkey, c_mktsegment, c_nationkey, false AS is_inferred FROM customer WHERE c_acctbal <= 9000
       UNION ALL SELECT DISTINCT c_custkey, 'Inferred', NULL::INTEGER, true FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000""",
)
def _(t):
    return dm.inferred_members(t.orders, "o_custkey", old_dim(t), "c_custkey")


@query(
    "m24_audit_columns",
    """SELECT n_nationkey, n_name, n_regionkey, 'b7' AS _batch_id, 'erp' AS _source, TIMESTAMP '2024-03-01' AS _loaded_at, md5(concat_ws('|', n_nationkey, n_name, n_regionkey)) AS _row_hash FROM nation""",
)
def _(t):
    return dm.with_audit(t.nation, "b7", "erp", dt.datetime(2024, 3, 1))


@query(
    "m25_conformed_dimension",
    f"""WITH {PAIR} SELECT c_custkey, CASE WHEN NOT had THEN 'extra' WHEN NOT has THEN 'missing' ELSE 'changed' END AS status, CASE WHEN had AND has THEN 'c_mktsegment' END AS changed
        FROM j WHERE NOT had OR NOT has OR dseg <> sseg""",
)
def _(t):
    out = dm.conformed(old_dim(t), source(t), "c_custkey", CUST)
    return out.withColumn("changed", F.array_join("changed", ","))
