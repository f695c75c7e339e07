"""Business analyses composed from the basic operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col_of, micros, money, period, safe_div
from tidemark.operators.joins import asof_join
from tidemark.operators.measures import pct_change
from tidemark.operators.ordered import neighbour, running_sums
from tidemark.session import settle

# Cumulative-share limits of the classes.
PARETO_CLASSES = {"A": 0.80, "B": 0.95}


def convert(df: DataFrame, amount: str, ccy: str, date: str, rates: DataFrame) -> DataFrame:
    """Amount at the latest rate known on its date; ``rates`` has ccy, valid_from, rate."""
    dated = rates.withColumnsRenamed({"ccy": ccy}) if ccy != "ccy" else rates
    out = asof_join(df, dated, [ccy], date, "valid_from", ["rate"])
    return out.withColumn("converted", F.col(amount) * F.col("rate"))


def revenue_by_segment(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue, orders, average order value and share per segment."""
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    seg = joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.sum(money("o_totalprice")).alias("revenue"), F.count(F.lit(1)).alias("n_orders")
    )
    whole = seg.agg(F.sum("revenue")).scalar()
    return seg.select(
        "segment", F.col("revenue").cast("double").alias("revenue"), "n_orders",
        safe_div("revenue", "n_orders").alias("aov"), safe_div("revenue", whole).alias("share"),
    )


def ntile_by_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, out: str) -> DataFrame:
    """SQL ``ntile(k)`` per group from distributed ranks; ``order`` must be unique."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(one, order, {"_r": "_one"}, by=by, totals={"_n": "_one"})
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (size + 1)
    low = F.ceil(F.col("_r") / (size + 1))
    high = extra + F.ceil(F.try_divide((F.col("_r") - head).cast("double"), size.cast("double")))
    tile = F.when(F.col("_r") <= head, low).otherwise(high)
    return ranked.withColumn(out, tile.cast("int")).drop("_r", "_n", "_one")


def rfm(orders: DataFrame, as_of: Sequence[str], customer: str, date: str, amount: str) -> DataFrame:
    """Recency, frequency and monetary scores 1-5 and a label per customer and snapshot date."""
    dates = F.array(*[F.lit(d).cast("date") for d in as_of])
    known = orders.select(customer, F.col(date).cast("date").alias("_d"), money(amount).alias("_m"))
    known = known.withColumn("as_of", F.explode(F.filter(dates, lambda x: x > F.col("_d"))))
    base = known.groupBy("as_of", customer).agg(
        F.datediff(F.col("as_of"), F.max("_d")).alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("_m").cast("double").alias("monetary"),
    )
    own = base.columns
    scores = {"r": -F.col("recency_days"), "f": F.col("frequency"), "m": F.col("monetary")}
    entries = F.array(*[F.struct(F.lit(s).alias("_score"), c.cast("double").alias("_by")) for s, c in scores.items()])
    tiles = ntile_by_rank(base.select("*", F.inline(entries)), ["as_of", "_score"], ["_by", customer], 5, "_tile")  # all three in one ordered pass
    picked = [F.max(F.when(F.col("_score") == s, F.col("_tile"))).alias(s) for s in scores]
    ranked = tiles.groupBy(*own).agg(*picked)
    r, fm = F.col("r"), (F.col("f") + F.col("m")) / 2
    label = (
        F.when((r >= 4) & (fm >= 4), "Champions").when((r >= 3) & (fm >= 3), "Loyal").when((r <= 2) & (fm >= 3), "At-Risk")
        .when((r <= 2) & (fm < 3), "Lost").when((r == 5) & (fm < 3), "New").otherwise("Regular")
    )
    return ranked.withColumn("segment", label)


def clv(orders: DataFrame, as_of: str, customer: str, date: str, amount: str, months: int = 12) -> DataFrame:
    """12-month projection: monthly order rate x average order x share of active months; value tier 1-4."""
    cut = F.lit(as_of).cast("date")
    past = orders.filter(F.col(date) < cut.cast("timestamp_ntz"))
    g = past.groupBy(customer).agg(
        F.sum(money(amount)).alias("v"),
        F.min(F.col(date).cast("date")).alias("first"),
        F.count_distinct(period(date, "month")).alias("active"),
    )
    life = F.greatest(F.lit(1), F.year(cut) * 12 + F.month(cut) - F.year("first") * 12 - F.month("first"))
    active = F.least(F.col("active"), life)
    # rate x average order = value per month, so one division keeps the figure exact
    value = (F.col("v") * months * active).cast("double") / (life * life).cast("double")
    probability = active.cast("double") / life.cast("double")
    scored = g.select(customer, F.round(probability, 6).alias("purchase_probability"), value.alias("clv"))
    return ntile_by_rank(scored, [], ["clv", customer], 4, "tier")


def cohort_retention(orders: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Retention, gross and net revenue retention per acquisition month and month offset."""
    month = period(date, "month").alias("month")
    act = orders.groupBy(customer, month).agg(F.sum(money(amount)).alias("rev"))
    start = act.groupBy(customer).agg(F.min("month").alias("cohort"), F.min_by("rev", "month").alias("rev0"))
    sizes = start.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"), F.sum("rev0").alias("base"))
    both = act.join(start, customer)
    offset = F.months_between("month", "cohort").cast("int").alias("month_offset")
    g = both.groupBy("cohort", offset).agg(
        F.count(F.lit(1)).alias("n_active"), F.sum("rev").alias("rev"), F.sum(F.least("rev", "rev0")).alias("kept")
    )
    return g.join(sizes, "cohort").select(
        "cohort", "month_offset", "n_active", safe_div("n_active", "size").alias("retention"),
        safe_div("kept", "base").alias("grr"), safe_div("rev", "base").alias("nrr"),
    )


def market_basket(lines: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """Item pairs with support, confidence and lift.

    Only pairs of frequent items are counted, beside each basket and then over all.
    ``min_support`` is a share of baskets, so the frequent items number at most
    (average basket size / min_support) however large the data or a basket is. A basket
    unfolds by its first item first, so no row holds all its pairs.
    """
    pairs = settle(lines.select(basket, F.col(item).cast("string").alias("_i")).distinct(), "basket-items")
    n = pairs.agg(F.count_distinct(F.col(basket)).alias("n")).first()["n"]  # one number
    frequent = pairs.groupBy("_i").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_support * n)
    frequent = settle(frequent, "frequent-items")
    useful = pairs.join(frequent.select("_i"), "_i", "left_semi")
    baskets = useful.groupBy(basket).agg(F.array_sort(F.collect_set("_i")).alias("items"))  # frequent items only
    firsts = baskets.select("items", F.posexplode("items").alias("_at", "item_a"))
    rest = F.slice("items", F.col("_at") + 2, F.size("items"))
    counted = firsts.select("item_a", F.explode(rest).alias("item_b")).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_baskets"))
    out = counted.filter(F.col("n_baskets") >= min_support * n)
    one = frequent.select("_i", "c")
    a = one.withColumnsRenamed({"_i": "item_a", "c": "_ca"})
    b = one.withColumnsRenamed({"_i": "item_b", "c": "_cb"})
    out = out.join(a, "item_a").join(b, "item_b")
    return out.select(
        "item_a", "item_b", "n_baskets", (F.col("n_baskets") / F.lit(n)).alias("support"),
        (F.col("n_baskets") / F.col("_ca")).alias("confidence_a_b"), (F.col("n_baskets") / F.col("_cb")).alias("confidence_b_a"),
        (F.col("n_baskets") * F.lit(float(n)) / (F.col("_ca") * F.col("_cb"))).alias("lift"),
    )


def pareto(df: DataFrame, key: str, measure: Column | str) -> DataFrame:
    """Cumulative share by descending measure and A/B/C class."""
    g = df.groupBy(key).agg(F.sum(col_of(measure)).alias("total")).withColumn("_neg", -F.col("total"))
    run = running_sums(g, ["_neg", key], {"_cum": "total"}, totals={"_all": "total"})
    share = safe_div("_cum", "_all")
    before = safe_div(F.col("_cum") - F.col("total"), "_all")
    cls = F.lit("C")
    for name, limit in reversed(PARETO_CLASSES.items()):
        cls = F.when(before < limit, name).otherwise(cls)
    return run.select(key, "total", share.alias("cum_share"), cls.alias("abc_class"))


def change_contribution(df: DataFrame, after: Column, comps: Sequence[str]) -> DataFrame:
    """Before/after mean per component and its part of the total change."""
    aggs = []
    for c in comps:
        aggs.append(F.struct(
            F.lit(c).alias("component"), F.avg(F.when(~after, F.col(c))).alias("before"), F.avg(F.when(after, F.col(c))).alias("after")
        ))
    rows = df.agg(F.array(*aggs).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda acc, x: acc + (x["after"] - x["before"])).alias("_total")
    out = rows.select(total, F.inline("r"))
    delta = F.col("after") - F.col("before")
    return out.select("component", "before", "after", delta.alias("delta"), (100 * safe_div(delta, "_total")).alias("pct_of_change"))


def driver_effects(df: DataFrame, by: str, after: Column, num: Column | str, den: Column | str) -> DataFrame:
    """Change of a ratio split per segment into rate effect and mix effect; they add up to the change."""
    n, d = col_of(num), col_of(den)
    g = df.groupBy(by).agg(
        F.sum(F.when(~after, n)).alias("n0"), F.sum(F.when(~after, d)).alias("d0"),
        F.sum(F.when(after, n)).alias("n1"), F.sum(F.when(after, d)).alias("d1"),
    )
    whole = g.agg(F.struct(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))).scalar()
    r0, r1 = F.coalesce(safe_div("n0", "d0"), F.lit(0.0)), F.coalesce(safe_div("n1", "d1"), F.lit(0.0))
    w0 = F.coalesce(safe_div("d0", whole["d0"]), F.lit(0.0))
    w1 = F.coalesce(safe_div("d1", whole["d1"]), F.lit(0.0))
    return g.select(by, r0.alias("rate_before"), r1.alias("rate_after"), (w1 * (r1 - r0)).alias("rate_effect"), ((w1 - w0) * r0).alias("mix_effect"))


def build_cycles(events: DataFrame, key: str, ts: str, kind: str, start: str, end: str, order: Sequence[str] = ()) -> DataFrame:
    """Cycles per entity: each start with the first end before the next start."""
    marks = events.filter(F.col(kind).isin(start, end)).withColumn("_s", (F.col(kind) == start).cast("long"))
    numbered = running_sums(marks, [ts, *order], {"cycle_no": "_s"}, by=[key]).filter("cycle_no > 0")
    g = numbered.groupBy(key, "cycle_no").agg(
        F.min(F.when(F.col(kind) == start, F.col(ts))).alias("started_at"),
        F.min(F.when(F.col(kind) == end, F.col(ts))).alias("ended_at"),
    )
    return g.withColumn("duration_hours", (micros("ended_at") - micros("started_at")) / F.lit(3.6e9))


def with_fallback(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fill NULLs of the main source from a second one and flag the rows."""
    second = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols])
    out = a.join(second, list(keys), "left")
    used = F.lit(False)
    for c in cols:
        used = used | (F.col(c).isNull() & F.col(f"_b_{c}").isNotNull())
    filled = {c: F.coalesce(c, f"_b_{c}") for c in cols}
    return out.withColumn("has_fallback", used).withColumns(filled).drop(*[f"_b_{c}" for c in cols])


def on_time_rate(df: DataFrame, plan: str, actual: str, tol_minutes: float, by: Sequence[str] = ()) -> DataFrame:
    ok = F.abs(micros(actual) - micros(plan)) <= tol_minutes * 60_000_000
    return df.groupBy(*by).agg((100.0 * safe_div(F.count(F.when(ok, 1)), F.count(F.lit(1)))).alias("on_time_pct"))


def otif(df: DataFrame, due: str, delivered: str, ordered: str, received: str, by: Sequence[str] = (), qty_tol: float = 0.02):
    """Delivered by the due date and within the quantity tolerance."""
    full = safe_div(F.abs(F.col(received) - F.col(ordered)), ordered) <= qty_tol
    ok = (F.col(delivered) <= F.col(due)) & full
    return df.groupBy(*by).agg((100.0 * safe_div(F.count(F.when(ok, 1)), F.count(F.lit(1)))).alias("otif_pct"))


def kpi_ratio(df: DataFrame, num: Column, den: Column, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Any KPI of the form sum(numerator) / sum(denominator)."""
    return df.groupBy(*by).agg((scale * safe_div(F.sum(num), F.sum(den))).alias("kpi"))


def segment_compare(df: DataFrame, dims: Sequence[str], after: Column, measure: Column | str) -> DataFrame:
    """Two-period comparison per segment: totals, change and % change."""
    v = col_of(measure)
    g = df.groupBy(*dims).agg(F.sum(F.when(~after, v)).alias("before"), F.sum(F.when(after, v)).alias("after"))
    return g.withColumn("change_pct", pct_change(F.col("after"), F.col("before")))


def build_legs(events: DataFrame, key: str, ts: str, place: str, order: Sequence[str] = ()) -> DataFrame:
    """Consecutive checkpoint pairs per entity with their duration."""
    used = dict.fromkeys([key, ts, place, *order])
    nxt = neighbour(events.select(*used), [key], [ts, *order], {"to_place": place, "arrived_at": ts}, step=1)
    legs = nxt.filter(F.col("arrived_at").isNotNull())
    hours = (micros("arrived_at") - micros(ts)) / F.lit(3.6e9)
    return legs.select(key, F.col(place).alias("from_place"), "to_place", F.col(ts).alias("left_at"), "arrived_at", hours.alias("hours"))


def hourly_utilisation(df: DataFrame, start: str, end: str, capacity: float) -> DataFrame:
    """Busy share of capacity per clock hour from activity intervals."""
    last = F.greatest(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    hours = F.sequence(F.date_trunc("hour", F.col(start).cast("timestamp")), F.date_trunc("hour", last.cast("timestamp")), F.expr("INTERVAL 1 HOUR"))
    cut = df.select(start, end, F.explode(hours).alias("hour"))
    lo = F.greatest(micros(start), micros("hour"))
    hi = F.least(micros(end), micros("hour") + 3_600_000_000)
    g = cut.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour")).agg((F.sum(hi - lo) / F.lit(3.6e9)).alias("busy_hours"))
    return g.withColumn("utilisation", F.col("busy_hours") / F.lit(float(capacity)))


def fixed_cohort(df: DataFrame, key: str, in_base: Column) -> DataFrame:
    """Only entities present in the base period, so that trends do not mix in newcomers."""
    members = df.filter(in_base).select(F.col(key).alias("_m"))
    return df.join(members, F.col(key) == F.col("_m"), "left_semi")


def kpi_table(df: DataFrame, kpis: Mapping[str, tuple[Column, Column, float]], by: Sequence[str] = ()) -> DataFrame:
    """Several ratio KPIs in one pass: ``{name: (numerator, denominator, scale)}``."""
    return df.groupBy(*by).agg(*[(s * safe_div(F.sum(n), F.sum(d))).alias(k) for k, (n, d, s) in kpis.items()])
