"""Statistics."""

from pyspark.sql import functions as F

from tidemark.functions import columns as fx, distributions as ds
from tidemark.operators import concordance, robust, stats as st
from tidemark.plans.registry import query
from tidemark.plans.sqltext import union

URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"


def urgent():
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


def rnd(*cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


def _describe(c):
    return f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, 0.0::DOUBLE AS missing_pct, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS sd, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, 0::BIGINT AS n_outliers FROM lineitem GROUP BY 1"""


@query("q1_descriptives", union(_describe(c) for c in ("l_quantity", "l_extendedprice")))
def _(t):
    out = st.describe_stats(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    six = ("q1", "median", "q3", "iqr", "skewness", "kurtosis")
    return out.withColumns({c: F.round(c, 6) for c in six} | {c: F.round(c, 5) for c in ("mean", "sd")})


@query(
    "q2_robust_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS hi FROM events GROUP BY 1),
            c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT event_type, value AS mode FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, value) = 1)
       SELECT event_type, round(avg(value) FILTER (value BETWEEN lo AND hi), 6) AS trimmed_mean, round(any_value(med), 6) AS median, round(median(abs(value - med)), 6) AS mad, any_value(mode) AS mode
       FROM events JOIN q USING (event_type) JOIN m USING (event_type) GROUP BY 1""",
)
def _(t):
    out = st.robust_stats(t.events, "value", ["event_type"])
    return out.select("event_type", *rnd("trimmed_mean", "median", "mad"), "mode")


# the t quantile by its expansion around the normal one, good to ten digits from a hundred rows on
T975 = """(z + (z*z*z + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3))
  + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(v, 4)))"""


@query(
    "q3_mean_ci",
    f"""WITH g AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean, sqrt(var_samp(o_totalprice) / count(*)) AS se, (count(*) - 1)::DOUBLE AS v, 1.959963984540054::DOUBLE AS z FROM orders GROUP BY 1)
        SELECT o_orderstatus, n, round(mean, 4) AS mean, round(mean - {T975} * se, 3) AS ci_low, round(mean + {T975} * se, 3) AS ci_high FROM g""",
)
def _(t):
    out = st.mean_ci(t.orders, ["o_orderstatus"], "o_totalprice")
    return out.select("o_orderstatus", "n", F.round("mean", 4).alias("mean"), *rnd("ci_low", "ci_high", n=3))


REPS, LEAVES = 10_000, 64


def _uniform(*node):
    text = " || '/' || ".join(["'42'", "CAST(rep AS VARCHAR)", *node])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


def _horner(coefficients, x):
    out = f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def _normal(u):
    """The normal quantile of column ``u`` by the published rational approximation."""
    low, high = f"sqrt(-2.0 * ln({u}))", f"sqrt(-2.0 * ln(1.0 - {u}))"
    mid = f"({u} - 0.5)"
    r = f"({mid} * {mid})"
    tail = lambda q: f"({_horner(ds.QUANTILE_C, q)} / {_horner((*ds.QUANTILE_D, 1.0), q)})"
    return f"CASE WHEN {u} < 0.02425 THEN {tail(low)} WHEN {u} > 1 - 0.02425 THEN -{tail(high)} ELSE {_horner(ds.QUANTILE_A, r)} * {mid} / {_horner((*ds.QUANTILE_B, 1.0), r)} END"


def _leaves(rows):
    """Ranges of equal shares of ``rows`` (column v) with their counts and moments."""
    cuts = ", ".join(repr(i / LEAVES) for i in range(1, LEAVES))
    return f"""cuts AS (SELECT quantile_cont(v, [{cuts}]) AS cut FROM {rows}),
      leaves AS (SELECT CAST(len(list_filter(cut, lambda q: q < v)) AS BIGINT) AS leaf, count(*)::DOUBLE AS c, avg(v) AS m, var_pop(v) AS s2 FROM {rows}, cuts GROUP BY 1)"""


BOOT = "SELECT round(avg(stat), 6) AS boot_mean, round(stddev_samp(stat), 6) AS boot_se, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high FROM stats"


def _booted(t, stat):
    return st.bootstrap_ci(t.events, "value", stat).select(*rnd("boot_mean", "boot_se", "ci_low", "ci_high"))


@query(
    "q4_bootstrap_mean",
    f"""WITH e AS (SELECT value AS v FROM events WHERE value IS NOT NULL), {_leaves('e')},
      u AS (SELECT rep, c, m, s2, {_uniform("CAST(leaf AS VARCHAR)", "'n'")} AS un, {_uniform("CAST(leaf AS VARCHAR)", "'s'")} AS us FROM range(1, {REPS + 1}) AS r(rep), leaves),
      z AS (SELECT *, {_normal('un')} AS zn, {_normal('us')} AS zs FROM u),
      w AS (SELECT *, greatest(0.0, floor(c + sqrt(c) * zn + (zn * zn - 1) / 6 + 0.5)) AS w FROM z),
      stats AS (SELECT rep, sum(w * m + sqrt(w * s2) * zs) / sum(w) AS stat FROM w GROUP BY rep) {BOOT}""",
)
def _(t):
    return _booted(t, "mean")


@query(
    "q4_bootstrap_median",
    f"""WITH e AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
      u AS (SELECT rep, {_uniform("'median'")} AS u FROM range(1, {REPS + 1}) AS r(rep)), z AS (SELECT rep, {_normal('u')} AS z, (SELECT max(n) FROM e) AS n FROM u),
      k AS (SELECT rep, least(greatest(ceil((0.5 + 0.5 / sqrt(n + 2) * (z - (z * z * z - 3 * z) / (4.0 * (n + 4)))) * n), 1), n) AS place FROM z),
      stats AS (SELECT rep, v AS stat FROM k JOIN e USING (place)) {BOOT}""",
)
def _(t):
    return _booted(t, "median")


def _binomial_tail(first, last, p):
    """P(first <= X <= last) of n draws with probability p."""
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))"
    return f"list_sum(list_transform(range({first}, {last} + 1), lambda j: {term}))"


@query(
    "q5_proportion_ci",
    f"""WITH RECURSIVE g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS x, count(*) AS n FROM orders GROUP BY 1),
          b AS (SELECT o_orderpriority, x, n, 0 AS step, 0.0::DOUBLE AS a0, 1.0::DOUBLE AS a1, 0.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM g
                UNION ALL
                SELECT o_orderpriority, x, n, step + 1, CASE WHEN low < 0.025 THEN (a0 + a1) / 2 ELSE a0 END, CASE WHEN low < 0.025 THEN a1 ELSE (a0 + a1) / 2 END,
                       CASE WHEN high > 0.025 THEN (b0 + b1) / 2 ELSE b0 END, CASE WHEN high > 0.025 THEN b1 ELSE (b0 + b1) / 2 END
                FROM (SELECT *, {_binomial_tail('x', 'n', '((a0 + a1) / 2)')} AS low, {_binomial_tail('0', 'x', '((b0 + b1) / 2)')} AS high FROM b WHERE step < 45) AS y)
        SELECT o_orderpriority, x, n, round(x::DOUBLE / n, 8) AS proportion, round(a0, 6) AS ci_low, round(b0, 6) AS ci_high FROM b WHERE step = 45""",
)
def _(t):
    out = st.proportion_ci(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")
    return out.select("o_orderpriority", "x", "n", F.round(F.col("x") / F.col("n"), 8).alias("proportion"), *rnd("ci_low", "ci_high", n=6))


ARMS = f"""m AS (SELECT count(*) FILTER (NOT u) AS n_a, count(*) FILTER (u) AS n_b, avg(v) FILTER (NOT u) AS mean_a, avg(v) FILTER (u) AS mean_b, var_samp(v) FILTER (NOT u) AS va, var_samp(v) FILTER (u) AS vb
  FROM (SELECT o_totalprice AS v, {URGENT} AS u FROM orders))"""


@query(
    "q6_welch_t",
    f"""WITH {ARMS} SELECT n_a, n_b, round(mean_b - mean_a, 5) AS diff, round((mean_b - mean_a) / sqrt(va / n_a + vb / n_b), 6) AS t,
              round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 4) AS df FROM m""",
)
def _(t):
    out = st.welch(t.orders, urgent(), "o_totalprice")
    return out.select("n_a", "n_b", F.round("diff", 5).alias("diff"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("q6_welch_p_value")
def _(t):
    return st.welch(t.orders, urgent(), "o_totalprice").select("t", "df", "p_value")


@query(
    "q7_one_sample_t",
    "SELECT count(*) AS n, round((avg(l_quantity) - 25.5) / sqrt(var_samp(l_quantity) / count(*)), 6) AS t, count(*) - 1 AS df FROM lineitem",
)
def _(t):
    return st.one_sample_t(t.lineitem, "l_quantity", 25.5).select("n", F.round("t", 6).alias("t"), "df")


@query(
    "q7_paired_t",
    "SELECT count(*) AS n, round(avg(l_tax - l_discount) / sqrt(var_samp(l_tax - l_discount) / count(*)), 6) AS t, count(*) - 1 AS df FROM lineitem",
)
def _(t):
    return st.paired_t(t.lineitem, "l_discount", "l_tax").select("n", F.round("t", 6).alias("t"), "df")


RANKS = "(SELECT v, count(*) AS n, count(*) FILTER (u) AS nb, sum(count(*)) OVER (ORDER BY v) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS rk FROM x GROUP BY v)"


@query(
    "q8_mann_whitney",
    f"""WITH x AS (SELECT l_quantity AS v, l_returnflag = 'R' AS u FROM lineitem WHERE l_returnflag <> 'N'), r AS {RANKS},
             s AS (SELECT sum(rk * nb)::DOUBLE AS rb, sum(pow(n::DOUBLE, 3) - n) AS ties, sum(n)::DOUBLE AS tot, sum(nb)::DOUBLE AS nb FROM r), q AS (SELECT *, rb - nb * (nb + 1) / 2 AS u, tot - nb AS na FROM s)
        SELECT u, round((u - na * nb / 2) / sqrt(na * nb / 12 * ((tot + 1) - ties / (tot * (tot - 1)))), 6) AS z, na::BIGINT AS n_a, nb::BIGINT AS n_b FROM q""",
)
def _(t):
    out = st.mann_whitney(t.lineitem.filter("l_returnflag <> 'N'"), F.col("l_returnflag") == "R", "l_quantity")
    return out.select("u", F.round("z", 6).alias("z"), "n_a", "n_b")


@query(
    "q9_kruskal_wallis",
    """WITH x AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem), r AS (SELECT v, count(*) AS n, sum(count(*)) OVER (ORDER BY v) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS rk FROM x GROUP BY v),
            c AS (SELECT g, sum(rk)::DOUBLE AS rs, count(*) AS ng FROM x JOIN r USING (v) GROUP BY 1), t AS (SELECT sum(pow(n::DOUBLE, 3) - n) AS ties, sum(n)::DOUBLE AS tot FROM r)
       SELECT round((12 / (tot * (tot + 1)) * (SELECT sum(rs * rs / ng) FROM c) - 3 * (tot + 1)) / (1 - ties / (pow(tot, 3) - tot)), 5) AS h, (SELECT count(*) - 1 FROM c) AS df FROM t""",
)
def _(t):
    return st.kruskal(t.lineitem, "l_returnflag", "l_quantity").select(F.round("h", 5).alias("h"), "df")


@query(
    "q9_wilcoxon",
    """WITH d AS (SELECT round(l_tax - l_discount, 4) AS d FROM lineitem WHERE round(l_tax - l_discount, 4) <> 0), r AS (SELECT abs(d) AS a, count(*) AS n, count(*) FILTER (d > 0) AS np, sum(count(*)) OVER (ORDER BY abs(d)) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS rk FROM d GROUP BY abs(d)),
            s AS (SELECT sum(rk * np)::DOUBLE AS w, sum(pow(n::DOUBLE, 3) - n) AS ties, sum(n)::DOUBLE AS n FROM r)
       SELECT w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z, n::BIGINT AS n FROM s""",
)
def _(t):
    df = t.lineitem.select(F.lit(0.0).alias("b"), F.round(F.col("l_tax") - F.col("l_discount"), 4).alias("a"))
    return st.wilcoxon(df, "b", "a").select("w", F.round("z", 6).alias("z"), "n")




@query(
    "q10_two_proportion_z",
    f"""WITH m AS (SELECT count(*) FILTER (NOT {URGENT}) AS n_a, count(*) FILTER (NOT {URGENT} AND o_orderstatus = 'F') AS x_a, count(*) FILTER ({URGENT}) AS n_b, count(*) FILTER ({URGENT} AND o_orderstatus = 'F') AS x_b FROM orders),
             z AS (SELECT *, (x_a + x_b)::DOUBLE / (n_a + n_b) AS p FROM m), y AS (SELECT n_a, x_a, n_b, x_b, (x_b::DOUBLE / n_b - x_a::DOUBLE / n_a) / sqrt(p * (1 - p) * (1.0 / n_a + 1.0 / n_b)) AS z FROM z),
             e AS (SELECT *, abs(z) / sqrt(2.0) AS q, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS k FROM y)
        SELECT n_a, x_a, n_b, x_b, round(z, 6) AS z, round((((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-q * q), 8) AS p_value FROM e""",
)
def _(t):
    out = st.two_proportion_z(t.orders, urgent(), F.col("o_orderstatus") == "F")
    return out.select("n_a", "x_a", "n_b", "x_b", F.round("z", 6).alias("z"), F.round("p_value", 8).alias("p_value"))


def _anova(group, y, src):
    return f"""SELECT (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f, count(*) - 1 AS k1, CAST(sum(n) - count(*) AS BIGINT) AS k2, sum(n * pow(m - gm, 2)) / (sum(n * pow(m - gm, 2)) + sum((n - 1) * v)) AS e
        FROM (SELECT {group} AS g, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v FROM {src} GROUP BY 1), (SELECT avg({y}) AS gm FROM {src})"""


@query(
    "q11_anova",
    f"SELECT round(f, 6) AS f, k1 AS df_between, k2 AS df_within, round(e, 10) AS eta_squared FROM ({_anova('o_orderpriority', 'o_totalprice', 'orders')})",
)
def _(t):
    out = st.anova(t.orders, "o_orderpriority", "o_totalprice")
    return out.select(F.round("f", 6).alias("f"), "df_between", "df_within", F.round("eta_squared", 10).alias("eta_squared"))


@query(
    "q12_pairwise_t",
    """WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
       SELECT a.g AS group_a, b.g AS group_b, round(b.m - a.m, 4) AS diff, round((b.m - a.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
              round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM g a JOIN g b ON a.g < b.g""",
)
def _(t):
    out = st.pairwise(t.orders, "o_orderpriority", "o_totalprice")
    return out.select("group_a", "group_b", F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("q12_pairwise")
def _(t):
    return st.pairwise(t.orders, "o_orderpriority", "o_totalprice")


@query(
    "q13_chi_square",
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
            s AS (SELECT sum(pow(o - ra * cb / n, 2) / (ra * cb / n)) AS x, min(ra * cb / n) AS lo, any_value(n) AS n FROM c JOIN r USING (a) JOIN k USING (b), n)
       SELECT round(x, 6) AS statistic, 8::BIGINT AS df, round(lo, 6) AS min_expected, round(sqrt(x / (n * 2)), 8) AS cramers_v, lo < 5 AS low_expected FROM s""",
)
def _(t):
    out = st.chi2(t.orders, "o_orderpriority", "o_orderstatus")
    return out.select(F.round("statistic", 6).alias("statistic"), "df", F.round("min_expected", 6).alias("min_expected"), F.round("cramers_v", 8).alias("cramers_v"), "low_expected")


@query(
    "q13_fisher_exact",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels),
            k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM c),
            l AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) AS lp FROM k),
            o AS (SELECT max(lp) FILTER (k = a) AS lp0 FROM l)
       SELECT a, b, c, d, round(least(1, sum(exp(lp)) FILTER (lp <= lp0 + 1e-7) / sum(exp(lp))), 8) AS p_value FROM l, o GROUP BY a, b, c, d""",
)
def _(t):
    table = t.labels.agg(
        *[F.count(F.when((F.col("quality") == q) & (F.col("toxic") == x), 1)).alias(n) for n, q, x in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))]
    )
    return st.fisher_exact(table).withColumn("p_value", F.round("p_value", 8))


PS = "p AS (SELECT p_brand, round(abs(avg(p_retailprice) - (SELECT avg(p_retailprice) FROM part)) / 100, 6) AS p FROM part GROUP BY 1)"


def p_values(t):
    """One pseudo p value per brand, derived from the part table."""
    mean = t.part.agg(F.avg("p_retailprice")).scalar()
    return t.part.groupBy("p_brand").agg(F.round(F.abs(F.avg("p_retailprice") - mean) / 100, 6).alias("p"))


@query("q14_bonferroni", f"WITH {PS} SELECT p_brand, p, round(least(1, p * (SELECT count(*) FROM p)), 6) AS p_adjusted FROM p")
def _(t):
    return st.adjust_p(p_values(t), "p", "bonferroni").withColumn("p_adjusted", F.round("p_adjusted", 6))


@query(
    "q14_benjamini_hochberg",
    f"""WITH {PS}, r AS (SELECT *, p * (SELECT count(*) FROM p) / rank() OVER (ORDER BY p) AS q FROM p)
        SELECT p_brand, p, round(least(1, min(q) OVER (ORDER BY p DESC)), 6) AS p_adjusted FROM r""",
)
def _(t):
    return st.adjust_p(p_values(t), "p").withColumn("p_adjusted", F.round("p_adjusted", 6))


@query(
    "q15_pearson",
    union(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))),
)
def _(t):
    return st.corr_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", F.round("r", 8))


@query(
    "q15_spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
       SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(a, b), 8) AS r FROM r""",
)
def _(t):
    return st.corr_matrix(t.lineitem, ["l_quantity", "l_extendedprice"], "spearman").withColumn("r", F.round("r", 8))


def _kendall(cells):
    """All pairs of distinct (x, y) cells with their counts n."""
    return f"""WITH c AS ({cells}), p AS (SELECT a.n * b.n AS w, sign(a.x - b.x) * sign(a.y - b.y) AS s FROM c a JOIN c b ON (a.x, a.y) < (b.x, b.y)),
      d AS (SELECT sum(w) FILTER (s > 0)::DOUBLE AS agree, sum(w) FILTER (s < 0)::DOUBLE AS against FROM p),
      t AS (SELECT (SELECT sum(n)::DOUBLE FROM c) AS n, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS t FROM c GROUP BY x)) AS tx, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS t FROM c GROUP BY y)) AS ty)
      SELECT CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS concordant, CAST(against AS BIGINT) AS discordant, round((agree - against) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 8) AS tau_b FROM d, t"""


def _tau(df, x, y):
    out = concordance.kendall(df, x, y)
    return out.select("n", *[F.col(c).cast("long").alias(c) for c in ("concordant", "discordant")], F.round("tau_b", 8).alias("tau_b"))


@query("q15_kendall", _kendall("SELECT p_size::DOUBLE AS x, p_retailprice AS y, count(*) AS n FROM part GROUP BY 1, 2"))
def _(t):
    return _tau(t.part, "p_size", "p_retailprice")


@query("q15_kendall_ties", _kendall("SELECT l_quantity::DOUBLE AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2"))
def _(t):
    return _tau(t.lineitem, "l_quantity", "l_discount")


@query(
    "q16_simple_ols",
    """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate, round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared, count(*) AS n FROM lineitem
       UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 8), count(*) FROM lineitem""",
)
def _(t):
    out = st.ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("r_squared", 8).alias("r_squared"), "n")


@query(
    "q16_ols_groups",
    """WITH g AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS m, count(*) AS n, var_samp(l_extendedprice) * (count(*) - 1) AS ss FROM lineitem GROUP BY 1), s AS (SELECT sum(ss) / (sum(n) - 3) AS s2 FROM g), a AS (SELECT * FROM g WHERE g = 'A')
       SELECT 'intercept' AS term, round(a.m, 4) AS estimate, round(sqrt(s2 / a.n), 4) AS std_error FROM a, s
       UNION ALL SELECT 'l_returnflag[' || g.g || ']', round(g.m - a.m, 4), round(sqrt(s2 * (1.0::DOUBLE / g.n + 1.0::DOUBLE / a.n)), 4) FROM g, a, s WHERE g.g <> 'A'""",
)
def _(t):
    out = st.ols(t.lineitem, "l_extendedprice", [], {"l_returnflag": ["A", "N", "R"]})
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query("q16_ols_dummies")
def _(t):
    return st.ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], {"l_returnflag": ["A", "N", "R"]})


@query(
    "q17_simple_ols_hc3",
    """WITH m AS (SELECT avg(l_quantity) AS xm, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem),
            e AS (SELECT l_quantity - xm AS d, (l_extendedprice - a - b * l_quantity) / (1 - (1.0::DOUBLE / n + pow(l_quantity - xm, 2) / sxx)) AS u, sxx, b FROM lineitem, m)
       SELECT 'l_quantity' AS term, round(any_value(b), 4) AS estimate, round(sqrt(sum(d * d * u * u)) / any_value(sxx), 4) AS std_error FROM e""",
)
def _(t):
    out = st.ols(t.lineitem, "l_extendedprice", ["l_quantity"], robust=True).filter("term = 'l_quantity'")
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


def _hc3(name, s, o):
    return f"""SELECT '{name}' AS term, round(b{s}, 4) AS estimate, round(sqrt(sum(pow(d{s} - S12 / S{o}{o} * d{o}, 2) * u * u)) / sum(pow(d{s} - S12 / S{o}{o} * d{o}, 2)), 4) AS std_error FROM u GROUP BY b{s}"""


@query(
    "q17_ols_hc3",
    """WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
            c AS (SELECT l_quantity - m1 AS d1, l_discount - m2 AS d2, l_extendedprice - my AS y, n FROM lineitem, m),
            s AS (SELECT sum(d1 * d1) AS S11, sum(d1 * d2) AS S12, sum(d2 * d2) AS S22, sum(d1 * y) AS S1y, sum(d2 * y) AS S2y FROM c),
            b AS (SELECT *, S11 * S22 - S12 * S12 AS det, (S22 * S1y - S12 * S2y) / (S11 * S22 - S12 * S12) AS b1, (S11 * S2y - S12 * S1y) / (S11 * S22 - S12 * S12) AS b2 FROM s),
            u AS (SELECT d1, d2, S11, S12, S22, b1, b2, (y - b1 * d1 - b2 * d2) / (1 - (1.0::DOUBLE / n + (d1 * d1 * S22 - 2 * d1 * d2 * S12 + d2 * d2 * S11) / det)) AS u FROM c, b)
       """ + _hc3("l_quantity", 1, 2) + " UNION ALL " + _hc3("l_discount", 2, 1),
)
def _(t):
    out = st.ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], robust=True).filter("term <> 'intercept'")
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query(
    "q18_logistic_binary",
    """WITH c AS (SELECT count(*) FILTER (l_discount > 0.05 AND l_returnflag = 'R')::DOUBLE AS a, count(*) FILTER (l_discount > 0.05 AND l_returnflag <> 'R')::DOUBLE AS b, count(*) FILTER (l_discount <= 0.05 AND l_returnflag = 'R')::DOUBLE AS c, count(*) FILTER (l_discount <= 0.05 AND l_returnflag <> 'R')::DOUBLE AS d FROM lineitem)
       SELECT 'high' AS term, round(ln(a * d / (b * c)), 5) AS estimate, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) AS std_error FROM c UNION ALL SELECT 'intercept', round(ln(c / d), 5), round(sqrt(1 / c + 1 / d), 5) FROM c""",
)
def _(t):
    df = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("high"))
    out = st.glm(df, "y", ["high"])
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@query(
    "q18_poisson_binary",
    """WITH n AS (SELECT c_custkey, c_acctbal > 0 AS h, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), g AS (SELECT sum(n) FILTER (h) AS s1, count(*) FILTER (h) AS k1, sum(n) FILTER (NOT h) AS s0, count(*) FILTER (NOT h) AS k0 FROM n)
       SELECT 'positive' AS term, round(ln((s1 / k1) / (s0 / k0)), 5) AS estimate, round(sqrt(1 / s1 + 1 / s0), 5) AS std_error FROM g UNION ALL SELECT 'intercept', round(ln(s0 / k0), 5), round(sqrt(1 / s0), 5) FROM g""",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = df.groupBy("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("positive")).agg(F.count("*").alias("n"))
    out = st.glm(df, "n", ["positive"], "poisson")
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@query("q18_logistic")
def _(t):
    return st.glm(t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "y", ["l_quantity", "l_discount"])


@query("q18_poisson")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("n"))
    return st.glm(df.withColumn("bal", F.col("c_acctbal") / 1000), "n", ["bal"], "poisson")


@query(
    "q19_effect_size",
    f"""WITH {ARMS} SELECT round(mean_b - mean_a, 5) AS absolute, round((mean_b - mean_a) / mean_a, 8) AS relative, round((mean_b - mean_a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 8) AS cohens_d FROM m""",
)
def _(t):
    out = st.effect_size(t.orders, urgent(), "o_totalprice")
    return out.select(F.round("absolute", 5).alias("absolute"), F.round("relative", 8).alias("relative"), F.round("cohens_d", 8).alias("cohens_d"))


@query(
    "q20_ab_report",
    f"""WITH {ARMS} SELECT n_a, n_b, round(mean_b - mean_a, 5) AS diff, CASE WHEN abs((mean_b - mean_a) / sqrt(va / n_a + vb / n_b)) > 1.96015 THEN CASE WHEN abs(mean_b - mean_a) >= 1000 THEN 'act' ELSE 'do_not_act_trivial' END
              WHEN abs(mean_b - mean_a) >= 1000 THEN 'do_not_act_underpowered' ELSE 'do_not_act_no_evidence' END AS decision FROM m""",
)
def _(t):
    out = st.ab_test(t.orders, urgent(), "o_totalprice", 1000)
    return out.select("n_a", "n_b", F.round("diff", 5).alias("diff"), "decision")


@query("q20_ab_intervals")
def _(t):
    return st.ab_test(t.orders, urgent(), "o_totalprice", 1000)


@query(
    "q21_required_n",
    """SELECT o_orderpriority, count(*) AS n, CAST(ceil(16 * var_samp(o_totalprice) / 25000000) AS BIGINT) AS required_n, round(sqrt(32 * var_samp(o_totalprice) / count(*)), 4) AS detectable_effect,
              count(*) >= 2 * ceil(16 * var_samp(o_totalprice) / 25000000) AS is_powered FROM orders GROUP BY 1""",
)
def _(t):
    return st.required_n(t.orders, ["o_orderpriority"], "o_totalprice", 5000).withColumn("detectable_effect", F.round("detectable_effect", 4))


@query(
    "q22_simpson",
    f"""WITH g AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) FILTER ({URGENT}) - avg(o_totalprice) FILTER (NOT {URGENT}) AS e FROM orders GROUP BY 1), w AS (SELECT avg(o_totalprice) FILTER ({URGENT}) - avg(o_totalprice) FILTER (NOT {URGENT}) AS a FROM orders),
             s AS (SELECT sum(e * n) / sum(n) AS adj, count(*) AS k, count(*) FILTER (e > 0) AS pos, count(*) FILTER (e < 0) AS neg FROM g)
        SELECT round(adj, 4) AS adjusted_effect, k AS n_strata, pos AS n_positive, neg AS n_negative, round(a, 4) AS aggregate_effect, sign(a) * sign(adj) < 0 AS sign_flips, (pos = k AND a < 0) OR (neg = k AND a > 0) AS is_simpson FROM s, w""",
)
def _(t):
    out = st.simpson(t.orders, urgent(), "o_totalprice", ["o_orderstatus"])
    return out.withColumns({"adjusted_effect": F.round("adjusted_effect", 4), "aggregate_effect": F.round("aggregate_effect", 4)})


@query(
    "q23_planted_effect",
    "SELECT count(*) AS n_treated, 5.0::DOUBLE AS att FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def _(t):
    """Where treatment adds 5 to an outcome that is otherwise the same for all, every matched pair differs by 5."""
    df = t.customer.withColumns({"treated": (F.col("c_mktsegment") == "BUILDING").cast("int"), "nation": F.col("c_nationkey").cast("double")})
    df = df.withColumn("outcome", 100.0 + 5.0 * F.col("treated"))
    return st.psm_att(df, "c_custkey", "treated", "outcome", ["c_acctbal", "nation"]).select("n_treated", F.round("att", 9).alias("att"))


@query("q23_propensity_matching")
def _(t):
    df = t.customer.withColumns({"treated": (F.col("c_mktsegment") == "BUILDING").cast("int"), "nation": F.col("c_nationkey").cast("double")})
    spend = t.orders.groupBy("o_custkey").agg(fx.money_sum("o_totalprice").alias("spend"))
    df = df.join(spend, F.col("o_custkey") == F.col("c_custkey"))
    return st.psm_att(df, "c_custkey", "treated", "spend", ["c_acctbal", "nation"])


@query(
    "q24_difference_in_differences",
    f"""WITH m AS (SELECT avg(o_totalprice) FILTER (u AND p) AS m11, avg(o_totalprice) FILTER (u AND NOT p) AS m10, avg(o_totalprice) FILTER (NOT u AND p) AS m01, avg(o_totalprice) FILTER (NOT u AND NOT p) AS m00,
               sqrt(var_samp(o_totalprice) FILTER (u AND p) / count(*) FILTER (u AND p) + var_samp(o_totalprice) FILTER (u AND NOT p) / count(*) FILTER (u AND NOT p) + var_samp(o_totalprice) FILTER (NOT u AND p) / count(*) FILTER (NOT u AND p) + var_samp(o_totalprice) FILTER (NOT u AND NOT p) / count(*) FILTER (NOT u AND NOT p)) AS se
               FROM (SELECT o_totalprice, {URGENT} AS u, o_orderdate >= TIMESTAMP '1998-01-01' AS p FROM orders))
        SELECT round(m11, 4) AS m11, round(m10, 4) AS m10, round(m01, 4) AS m01, round(m00, 4) AS m00, round(m11 - m10 - (m01 - m00), 4) AS effect, round(se, 4) AS se FROM m""",
)
def _(t):
    post = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return st.did(t.orders, urgent(), post, "o_totalprice").select(*rnd("m11", "m10", "m01", "m00", "effect", "se", n=4))


TWO_ARMS = f"""WITH e AS (SELECT value AS v, event_type = 'click' AS b FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL),
  o AS (SELECT avg(v) FILTER (b) - avg(v) FILTER (NOT b) AS d, count(*) FILTER (b)::DOUBLE AS nb, count(*)::DOUBLE AS n, sum(v) AS total FROM e), {_leaves('e')}"""
PERMUTED = f"""us AS (SELECT rep, c, m, s2, h, {_uniform("CAST(leaf AS VARCHAR)", "'s'")} AS u FROM drawn),
  zs AS (SELECT *, {_normal('u')} AS z FROM us),
  arms AS (SELECT rep, sum(h) AS size, sum(h * m + sqrt(h * (c - h) / greatest(c - 1, 1) * s2) * z) AS total FROM zs GROUP BY rep)
  SELECT round(any_value(d), 6) AS observed, count(*) AS n_permutations, round((count(*) FILTER (abs(a.total / a.size - (o.total - a.total) / (n - a.size)) >= abs(d)) + 1) / (count(*) + 1), 8) AS p_value FROM arms AS a, o"""


def _tree():
    """Rows of one arm dealt down a binary tree of ranges, each split hypergeometric."""
    parts = [f"full_leaves AS (SELECT i AS leaf, coalesce(c, 0.0) AS c FROM range({LEAVES}) AS r(i) LEFT JOIN leaves ON leaf = i)",
             f"t{LEAVES} AS (SELECT rep, 1 AS node, nb AS h FROM range(1, {REPS + 1}) AS r(rep), o)"]
    width = LEAVES
    while width > 1:
        parts += [
            f"n{width} AS (SELECT {LEAVES // width} + leaf // {width} AS node, sum(c) AS c, sum(c) FILTER (leaf % {width} < {width // 2}) AS l FROM full_leaves GROUP BY 1)",
            f"u{width} AS (SELECT rep, node, h, c, l, {_uniform('CAST(node AS VARCHAR)', chr(39) + 'n' + chr(39))} AS u FROM t{width} JOIN n{width} USING (node))",
            f"z{width} AS (SELECT *, {_normal('u')} AS z, h * l / c AS share FROM u{width})",
            f"""s{width} AS (SELECT rep, node, h, CASE WHEN c > 0 THEN least(greatest(floor(share + sqrt(greatest(0.0, share * (1 - l / c) * (c - h) / greatest(c - 1, 1.0))) * z
                + (c - 2 * l) * (c - 2 * h) / (c * greatest(c - 2, 1.0)) * (z * z - 1) / 6 + 0.5), 0.0, h - (c - l)), h, l) ELSE 0.0 END AS d FROM z{width})""",
            f"t{width // 2} AS (SELECT rep, 2 * node AS node, d AS h FROM s{width} UNION ALL SELECT rep, 2 * node + 1, h - d FROM s{width})",
        ]
        width //= 2
    return ", ".join(parts) + f", drawn AS (SELECT rep, leaf, c, m, s2, h FROM t1 JOIN leaves ON leaf = node - {LEAVES})"


def _clicks(t, exact):
    df = t.events.filter("event_type IN ('view', 'click')")
    out = st.permutation_test(df, F.col("event_type") == "click", "value", exact=exact)
    return out.select(F.round("observed", 6).alias("observed"), "n_permutations", F.round("p_value", 8).alias("p_value"))


@query("q25_permutation_test", f"{TWO_ARMS}, {_tree()}, {PERMUTED}")
def _(t):
    return _clicks(t, True)


@query(
    "q25_rerandomisation",
    f"""{TWO_ARMS}, un AS (SELECT rep, leaf, c, m, s2, nb / n AS q, {_uniform("CAST(leaf AS VARCHAR)", "'n'")} AS u FROM range(1, {REPS + 1}) AS r(rep), leaves, o),
      zn AS (SELECT *, {_normal('u')} AS z FROM un),
      drawn AS (SELECT rep, leaf, c, m, s2, least(greatest(floor(c * q + sqrt(c * (q * (1 - q))) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5), 0.0), c) AS h FROM zn), {PERMUTED}""",
)
def _(t):
    return _clicks(t, False)


@query(
    "q26_leave_one_out",
    """WITH g AS (SELECT c_nationkey, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM g)
       SELECT c_nationkey, round((t.s - g.s) / (t.n - g.n), 4) AS mean_without, round((t.s - g.s) / (t.n - g.n) - t.s / t.n, 4) AS shift FROM g, t""",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return st.leave_one_out(df, "c_nationkey", "o_totalprice").select("c_nationkey", *rnd("mean_without", "shift", n=4))


@query(
    "q26_outlier_sensitivity",
    """WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events), m AS (SELECT avg(value) AS a, avg(least(greatest(value, lo), hi)) AS w FROM events, b)
       SELECT round(a, 6) AS mean, round(w, 6) AS winsorized_mean, round(100 * (w - a) / abs(a), 6) AS change_pct FROM m""",
)
def _(t):
    return st.outlier_sensitivity(t.events, "value").select(*rnd("mean", "winsorized_mean", "change_pct"))


@query(
    "q27_missingness",
    """SELECT 'prio' AS "column", count(*) FILTER (o_orderpriority = '5-LOW') AS n_missing, round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 4) AS mean_missing, round(avg(o_totalprice) FILTER (o_orderpriority <> '5-LOW'), 4) AS mean_present,
              round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') - avg(o_totalprice) FILTER (o_orderpriority <> '5-LOW'), 4) AS difference FROM orders""",
)
def _(t):
    df = t.orders.withColumn("prio", fx.nullify("o_orderpriority", ["5-LOW"]))
    return st.missingness(df, ["prio"], "o_totalprice").select("column", "n_missing", *rnd("mean_missing", "mean_present", "difference", n=4))


def _holes(t, dependent):
    """Orders with a third of the dates missing: by a hash, or where the price is high."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("hole/"), F.col("o_orderkey").cast("string"))), 1, 6), 16, 10).cast("long")
    gone = F.col("o_totalprice") > 300000 if dependent else draw % 3 == 0
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    noise = F.when(draw % 5 > 0, F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6), 16, 10).cast("double"))
    df = t.orders.select("o_totalprice", F.when(~gone, day).alias("day"), noise.alias("noise"))
    out = robust.littles_test(df, ["o_totalprice", "day", "noise"])
    return out.select("n", "n_patterns", "df", (F.col("p_value") < 0.001).alias("is_dependent"))


for _name, _dependent in (("q27_missing_at_random", False), ("q27_missing_dependent", True)):
    _gone = "o_totalprice > 300000" if _dependent else "h % 3 = 0"

    @query(
        _name,
        f"""WITH o AS (SELECT o_totalprice, ('0x' || substr(md5('hole/' || CAST(o_orderkey AS VARCHAR)), 1, 6))::BIGINT AS h FROM orders), p AS (SELECT ({_gone}) AS a, h % 5 = 0 AS b, count(*) AS n FROM o GROUP BY 1, 2)
            SELECT CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS INTEGER) AS n_patterns, CAST(sum(3 - a::INT - b::INT) - 3 AS INTEGER) AS df, {str(_dependent).lower()} AS is_dependent FROM p""",
    )
    def _(t, dependent=_dependent):
        return _holes(t, dependent)


@query(
    "q28_autocorrelation",
    """WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), e AS (SELECT *, n - avg(n) OVER (PARTITION BY event_type) AS e, lag(n, 7) OVER w AS l FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)),
            d AS (SELECT *, lag(e) OVER (PARTITION BY event_type ORDER BY day) AS e1 FROM e)
       SELECT event_type, round(corr(n, l), 8) AS autocorrelation, round(sum(pow(e - e1, 2)) / sum(e * e), 8) AS durbin_watson FROM d GROUP BY 1""",
)
def _(t):
    s = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return st.autocorr(s, ["event_type"], "day", "n", 7).select("event_type", *rnd("autocorrelation", "durbin_watson", n=8))


@query(
    "q29_variance_explained",
    union(f"SELECT '{g}' AS factor, round(f, 6) AS f, k1 AS df_between, k2 AS df_within, round(e, 10) AS eta_squared FROM ({_anova(g, 'o_totalprice', 'orders')})" for g in ("o_orderpriority", "o_orderstatus")),
)
def _(t):
    out = st.variance_explained(t.orders, "o_totalprice", ["o_orderpriority", "o_orderstatus"])
    return out.withColumns({"f": F.round("f", 6), "eta_squared": F.round("eta_squared", 10)})


@query(
    "q30_e_value",
    f"""WITH g AS (SELECT c_mktsegment, count(*) FILTER ({URGENT} AND o_orderstatus = 'F')::DOUBLE / count(*) FILTER ({URGENT}) AS re, count(*) FILTER (NOT {URGENT} AND o_orderstatus = 'F')::DOUBLE / count(*) FILTER (NOT {URGENT}) AS ro FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
             r AS (SELECT *, re / ro AS rr, greatest(re / ro, ro / re) AS m FROM g)
        SELECT c_mktsegment, round(re, 8) AS risk_exposed, round(ro, 8) AS risk_other, round(rr, 8) AS risk_ratio, round(m + sqrt(m * (m - 1)), 6) AS e_value FROM r""",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = st.risk_ratio(df, urgent(), F.col("o_orderstatus") == "F", ["c_mktsegment"])
    return out.select("c_mktsegment", *rnd("risk_exposed", "risk_other", "risk_ratio", n=8), F.round("e_value", 6).alias("e_value"))
