"""Scalar helpers."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.plans.registry import query

PRIO = "nullif(o_orderpriority, '5-LOW')"


@query(
    "h1_concatenation",
    f"""SELECT o_orderkey, o_orderstatus || '-' || {PRIO} AS strict_text, concat_ws('-', o_orderstatus, {PRIO}) AS skip_text FROM orders""",
)
def _(t):
    p = fx.nullify("o_orderpriority", ["5-LOW"])
    return t.orders.select(
        "o_orderkey",
        fx.concat_strict(F.col("o_orderstatus"), F.lit("-"), p).alias("strict_text"),
        fx.concat_skip(F.col("o_orderstatus"), p, sep="-").alias("skip_text"),
    )


@query(
    "h2_norm_text",
    r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS norm_md5 FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.md5(fx.norm_text("text")).alias("norm_md5"))


@query("h3_regex_match", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[0-9]$') AS is_short FROM part")
def _(t):
    return t.part.select("p_partkey", fx.matches("p_brand", "^Brand#[0-9]$").alias("is_short"))


@query(
    "h4_periods",
    """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
              CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(date_trunc('year', o_orderdate) AS DATE) AS year FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", *[fx.period("o_orderdate", u).alias(u) for u in ("week", "month", "quarter", "year")])


@query(
    "h5_date_arithmetic",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS plus10, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month,
              last_day(o_orderdate) AS month_end, CAST(date_diff('day', o_orderdate, last_day(o_orderdate)) AS INTEGER) AS days_left FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        fx.add_period("o_orderdate", 10, "day").alias("plus10"),
        fx.add_period("o_orderdate", 1, "month").alias("next_month"),
        fx.month_end("o_orderdate").alias("month_end"),
        fx.days_between("o_orderdate", fx.month_end("o_orderdate")).alias("days_left"),
    )


@query(
    "h6_local_period",
    """SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS local_day FROM events""",
)
def _(t):
    return t.events.select("event_id", fx.local_period("ts", "America/New_York", "day").alias("local_day"))


@query(
    "h7_multi_format_parse",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS parsed FROM orders""",
)
def _(t):
    layout = {"1-URGENT": "yyyy-MM-dd HH:mm:ss", "2-HIGH": "yyyy-MM-dd'T'HH:mm:ss'Z'", "3-MEDIUM": "yyyy-MM-dd"}
    text = F.date_format("o_orderdate", "MM/dd/yyyy")
    for name, fmt in layout.items():
        text = F.when(F.col("o_orderpriority") == name, F.date_format("o_orderdate", fmt)).otherwise(text)
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date")).otherwise(text)
    return t.orders.select("o_orderkey", fx.parse_ts(text).alias("parsed"))


@query(
    "h8_tolerant_cast",
    """SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', CASE WHEN p_type = 'PROMO' THEN 'x' ELSE '' END) AS DOUBLE) AS num FROM part""",
)
def _(t):
    text = F.regexp_replace("p_brand", F.lit("Brand#"), F.when(F.col("p_type") == "PROMO", "x").otherwise(""))
    return t.part.select("p_partkey", fx.to_num(text).alias("num"))


@query(
    "h9_hours_between",
    """SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3.6e9, 6) AS hours FROM events""",
)
def _(t):
    return t.events.select("event_id", F.round(fx.hours_between(F.date_trunc("day", "ts"), "ts"), 6).alias("hours"))


@query(
    "h10_hash_key",
    f"""SELECT o_orderkey, md5(concat_ws('|', CAST(o_custkey AS VARCHAR), coalesce({PRIO}, '∅'))) AS hash_key FROM orders""",
)
def _(t):
    p = fx.nullify("o_orderpriority", ["5-LOW"])
    return t.orders.select("o_orderkey", fx.hash_key(["o_custkey", p]).alias("hash_key"))


@query("h11_json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", fx.json_get("props", "$.k", "int").alias("k"))


@query(
    "h12_currency_convert",
    """WITH rates AS (SELECT CAST(n_nationkey AS VARCHAR) AS ccy, m AS valid_from, CAST(1 + n_nationkey / 100.0 + month(m) / 1000.0 AS DECIMAL(10,3)) AS rate
                      FROM nation, (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP FROM orders), (SELECT max(o_orderdate)::TIMESTAMP FROM orders), INTERVAL 1 MONTH)) AS m))
       SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * rate, 2) AS DOUBLE) AS converted FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN rates ON ccy = CAST(c_nationkey AS VARCHAR) AND valid_from = date_trunc('month', o_orderdate)""",
)
def _(t):
    from tidemark.operators.business import convert
    from tidemark.operators.joins import cross_spine

    first, last = (t.orders.agg(F.trunc(f("o_orderdate"), "month")).scalar() for f in (F.min, F.max))
    rates = cross_spine(t.nation.withColumns({"_first": first, "_last": last}), "_first", "_last", "1 month", "m")
    rates = rates.select(
        F.col("n_nationkey").cast("string").alias("ccy"),
        F.col("m").cast("timestamp_ntz").alias("valid_from"),
        (1 + F.col("n_nationkey") / F.lit(100.0) + F.month("m") / F.lit(1000.0)).cast("decimal(10,3)").alias("rate"),
    )
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = df.select("o_orderkey", "o_orderdate", fx.money("o_totalprice").alias("o_totalprice"), F.col("c_nationkey").cast("string").alias("ccy"))
    out = convert(df, "o_totalprice", "ccy", "o_orderdate", rates)
    return out.select("o_orderkey", F.round("converted", 2).cast("double").alias("converted"))


@query("h13_date_key", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key FROM orders")
def _(t):
    return t.orders.select("o_orderkey", fx.date_key("o_orderdate").alias("date_key"))


@query(
    "h14_fiscal",
    """WITH s AS (SELECT o_orderkey, o_orderdate + INTERVAL 9 MONTH AS d FROM orders)
       SELECT o_orderkey, CAST(year(d) AS INTEGER) AS fiscal_year, CAST(quarter(d) AS INTEGER) AS fiscal_quarter,
              'FY' || year(d) || '-P' || lpad(CAST(month(d) AS VARCHAR), 2, '0') AS fiscal_period FROM s""",
)
def _(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in fx.fiscal("o_orderdate", 4).items()])


@query(
    "h15_winsorize",
    """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, lo), hi), 6) AS winsorized,
              round(ln(1 + l_extendedprice), 8) AS log_value FROM lineitem, b""",
)
def _(t):
    from tidemark.operators.stats import winsorize

    out = winsorize(t.lineitem, "l_extendedprice", 0.05, 0.95)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("winsorized", 6).alias("winsorized"),
        F.round(F.log1p("l_extendedprice"), 8).alias("log_value"),
    )
