"""Leakage-safe features, splits and model evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.functions.columns import col_of, money, safe_div
from tidemark.operators.ordered import exact_quantiles, running_sums, unpivot_numeric, value_counts_table
from tidemark.operators.windows import day_number
from tidemark.session import new_path, settle, shuffle_width

# Feature and label windows in days around an as-of date.
FEATURE_DAYS, RECENT_DAYS = 180, 30
LABEL_FROM, LABEL_TO = 30, 120


def split_temporal(df: DataFrame, date: str, train_end: str, val_end: str) -> DataFrame:
    """train before ``train_end``, val before ``val_end``, test from there on."""
    d = F.col(date).cast("date")
    label = F.when(d < F.lit(train_end).cast("date"), "train").when(d < F.lit(val_end).cast("date"), "val").otherwise("test")
    return df.withColumn("split", label)


def time_folds(df: DataFrame, date: str, n: int = 5, gap_days: int = 7) -> DataFrame:
    """Walk-forward folds cut by date: train before the test block, minus a gap in days."""
    day = df.withColumn("_day", day_number(date))
    cuts = exact_quantiles(day, "_day", {f"c{i}": i / (n + 1) for i in range(1, n + 1)}).first()  # n numbers
    edges = [int(-(-cuts[f"c{i}"] // 1)) for i in range(1, n + 1)] + [2**31 - 1]
    spec = F.array(
        *[F.struct(F.lit(i + 1).alias("fold"), F.lit(edges[i]).alias("a"), F.lit(edges[i + 1]).alias("b")) for i in range(n)]
    )
    rows = day.select("*", F.inline(spec))
    d = F.col("_day")
    role = F.when(d < F.col("a") - gap_days, "train").when((d >= F.col("a")) & (d < F.col("b")), "test")
    return rows.withColumn("role", role).filter("role IS NOT NULL").drop("_day", "a", "b")


def _as_of_array(dates: Sequence[str]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in dates])


def user_features(
    events: DataFrame, as_of: Sequence[str], user: str, ts: str, kind: str, amount: str, ticket: str, days: int = FEATURE_DAYS
) -> DataFrame:
    """Counts, recency, spend and tickets from the days strictly before each as-of date; one pass."""
    d = F.col(ts).cast("date")
    mine = F.filter(_as_of_array(as_of), lambda a: (d >= F.date_add(a, -days)) & (d <= F.date_add(a, -1)))
    rows = events.select(user, d.alias("_d"), kind, money(amount).alias("_m"), F.explode(mine).alias("as_of"))
    recent = F.col("_d") >= F.date_add("as_of", -RECENT_DAYS)
    return rows.groupBy(user, "as_of").agg(
        F.count(F.lit(1)).alias("events_window"),
        F.count(F.when(recent, 1)).alias("events_30d"),
        F.datediff("as_of", F.max("_d")).alias("days_since_last"),
        F.sum("_m").cast("double").alias("spend_window"),
        F.count(F.when(F.col(kind) == ticket, 1)).alias("tickets"),
    )


def churn_labels(
    events: DataFrame, as_of: Sequence[str], user: str, ts: str, lo: int = LABEL_FROM, hi: int = LABEL_TO
) -> DataFrame:
    """1 when a user known before the as-of date has no event in [as_of + lo, as_of + hi)."""
    d = F.col(ts).cast("date")
    dates = _as_of_array(as_of)
    rows = events.select(user, d.alias("_d"), F.explode(dates).alias("as_of"))
    later = (F.col("_d") >= F.date_add("as_of", lo)) & (F.col("_d") < F.date_add("as_of", hi))
    g = rows.groupBy(user, "as_of").agg(
        F.count(F.when(F.col("_d") < F.col("as_of"), 1)).alias("_before"), F.count(F.when(later, 1)).alias("_after")
    )
    return g.filter("_before > 0").select(user, "as_of", (F.col("_after") == 0).cast("int").alias("churn"))


def leakage_audit(features: DataFrame, as_of: str, stamps: Sequence[str]) -> DataFrame:
    """Rows per feature timestamp that are not strictly before the as-of date."""
    out = [
        F.struct(
            F.lit(c).alias("feature"), F.count(F.when(F.col(c) >= F.col(as_of), 1)).alias("n_leaks"),
            F.max(F.datediff(F.col(c), F.col(as_of))).alias("worst_days"),
        )
        for c in stamps
    ]
    return features.agg(F.array(*out).alias("r")).select(F.inline("r")).withColumn("is_clean", F.col("n_leaks") == 0)


def impute(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Medians of ``train`` fill ``other``; a flag keeps the fact of being missing."""
    m = exact_quantiles(unpivot_numeric(train, cols), "value", {"m": 0.5}, by=["column"])
    med = m.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in cols]).select(F.struct(*cols)).scalar()
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in cols}
    return other.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), med[c]) for c in cols})


def encode(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ordinal code (sorted order, unseen is -1) and training frequency per category."""
    out = other
    for c in cols:
        counts = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
        codes = running_sums(counts, [c], {"_code": "_one"}, totals={"_all": "_n"})
        side = codes.select(F.col(c).alias("_v"), (F.col("_code") - 1).alias("_code"), (F.col("_n") / F.col("_all")).alias("_freq"))
        out = out.join(side, F.col(c) == F.col("_v"), "left")
        out = out.withColumns({f"{c}_code": F.coalesce("_code", F.lit(-1)), f"{c}_freq": F.coalesce("_freq", F.lit(0.0))})
        out = out.drop("_v", "_code", "_freq")
    return out


def baselines(df: DataFrame, key: Sequence[str], date: str, val: str, lag_days: int = 7, n: int = 7) -> DataFrame:
    """Last value, seasonal naive and moving average of earlier days (one row per key and day)."""
    from tidemark.operators.drift import seasonal_naive

    w = W.partitionBy(*key).orderBy(date)
    out = seasonal_naive(df, key, date, val, lag_days).withColumnRenamed("forecast", "seasonal_naive").drop("residual")
    return out.withColumns(
        {"last_value": F.lag(val).over(w), "moving_average": F.avg(val).over(w.rowsBetween(-n, -1))}
    )


def prevalence_baseline(df: DataFrame, y: str, rule: Column) -> DataFrame:
    """Prevalence, majority accuracy and the accuracy of a simple rule."""
    t = F.col(y) == 1
    n = F.count(F.lit(1))
    p = safe_div(F.count(F.when(t, 1)), n)
    return df.agg(
        p.alias("prevalence"), F.greatest(p, 1 - p).alias("majority_accuracy"),
        safe_div(F.count(F.when(rule == t, 1)), n).alias("rule_accuracy"),
    )


# --- metrics ----------------------------------------------------------------------------


def _threshold_table(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    counts = value_counts_table(df, p, {"n": F.lit(True), "pos": F.col(y) == 1}, by=by).withColumn("_down", -F.col(p))
    return running_sums(counts, ["_down"], {"cn": "n", "cp": "pos"}, by=by, totals={"n_all": "n", "p_all": "pos"})


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC-ROC with ties at one half, AUC-PR as average precision."""
    t = _threshold_table(df, y, p, by)
    neg = F.col("n") - F.col("pos")
    above = F.col("cp") - F.col("pos")  # positives scored strictly higher
    area = F.sum(neg * (above + F.col("pos") / 2))
    ap = F.sum(F.col("pos") * safe_div("cp", "cn"))
    n1, n0 = F.max("p_all"), F.max("n_all") - F.max("p_all")
    return t.groupBy(*by).agg(safe_div(area, n1 * n0).alias("auc_roc"), safe_div(ap, n1).alias("auc_pr"))


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = (), beta: float = 2.0):
    """Confusion counts, precision, recall, F1 and F-beta at a threshold."""
    yes, hit = F.col(y) == 1, F.col(p) >= threshold
    m = df.groupBy(*by).agg(
        F.count(F.when(yes & hit, 1)).alias("tp"), F.count(F.when(~yes & hit, 1)).alias("fp"),
        F.count(F.when(yes & ~hit, 1)).alias("fn"), F.count(F.when(~yes & ~hit, 1)).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b2 = beta * beta
    return m.withColumns(
        {
            "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn),
            "f_beta": safe_div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
            "accuracy": safe_div(tp + F.col("tn"), tp + fp + fn + F.col("tn")),
        }
    )


def at_k(df: DataFrame, group: Sequence[str], y: str, p: str, key: str, k: int) -> DataFrame:
    """Precision, recall, lift and NDCG at k per group; ties by key."""
    top = W.partitionBy(*group).orderBy(F.desc(p), F.asc(key))
    ideal = W.partitionBy(*group).orderBy(F.desc(y), F.asc(key))
    gain = F.col(y) / F.log2(F.col("_r") + F.lit(1.0))
    a = df.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k)
    a = a.groupBy(*group).agg(F.sum(y).alias("_hits"), F.count(F.lit(1)).alias("_k"), F.sum(gain).alias("_dcg"))
    b = df.withColumn("_r", F.row_number().over(ideal)).filter(F.col("_r") <= k).groupBy(*group).agg(F.sum(gain).alias("_idcg"))
    t = df.groupBy(*group).agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    j = a.join(b, list(group)).join(t, list(group))
    prec = safe_div("_hits", "_k")
    return j.select(
        *group, prec.alias("precision_at_k"), safe_div("_hits", "_pos").alias("recall_at_k"),
        safe_div(prec, safe_div("_pos", "_n")).alias("lift_at_k"), safe_div("_dcg", "_idcg").alias("ndcg_at_k"),
    )


def regression_metrics(df: DataFrame, y: str, f: str, by: Sequence[str] = (), naive: str | None = None) -> DataFrame:
    """MAE, RMSE, MAPE, R2, WAPE; MASE against the error of a naive forecast column."""
    known = df.filter(F.col(y).isNotNull() & F.col(f).isNotNull())
    v, e = F.col(y).cast("double"), F.col(y) - F.col(f)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(safe_div(F.abs(e), F.abs(v)))).alias("mape"),
        (1 - safe_div(F.sum(e * e), F.var_pop(v) * F.count(F.lit(1)))).alias("r2"),
        (100 * safe_div(F.sum(F.abs(e)), F.sum(F.abs(v)))).alias("wape"),
    ]
    if naive is not None:
        aggs.append(safe_div(F.avg(F.abs(e)), F.avg(F.abs(v - F.col(naive)))).alias("mase"))
    return known.groupBy(*by).agg(*aggs)


def best_threshold(df: DataFrame, y: str, p: str, cost_fp: float = 10, cost_fn: float = 100) -> DataFrame:
    """Cheapest of the cut-offs 0.01 ... 0.99, the first one on ties.

    Rows collapse to 100 score buckets; the costs are sums over those.
    """
    step = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(F.col(p) * 100 + 1e-9))).cast("int")
    b = df.groupBy(step.alias("b")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    cuts = b.select(F.explode(F.sequence(F.lit(1), F.lit(99))).alias("cut"), "b", "pos", "neg")  # 99 x 100 rows
    c = cuts.groupBy("cut").agg(
        F.sum(F.when(F.col("b") >= F.col("cut"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("b") < F.col("cut"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    cost = F.col("fp") * cost_fp + F.col("fn") * cost_fn
    best = c.agg(F.min(F.struct(cost.cast("double").alias("cost"), "cut", "fp", "fn")).alias("m"))
    return best.select((F.col("m.cut") / 100).alias("threshold"), "m.cost", "m.fp", "m.fn")


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed_rate")
    )


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.avg(e * e).alias("brier"))


def isotonic(train: DataFrame, other: DataFrame, y: str, p: str, out: str = "calibrated") -> DataFrame:
    """Monotone recalibration fitted on ``train`` and applied to ``other``.

    The fit sees one weighted row per distinct score.
    """
    agg = train.groupBy(F.col(p).cast("double").alias("_f")).agg(F.avg(F.col(y).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    feats = VectorAssembler(inputCols=["_f"], outputCol="_v")
    model = IsotonicRegression(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol=out).fit(feats.transform(agg))
    scored = model.transform(feats.transform(other.withColumn("_f", F.col(p).cast("double"))))
    return scored.drop("_f", "_v")


def slice_metrics(df: DataFrame, y: str, p: str, slices: Sequence[str], threshold: float = 0.5, gap: float = 0.10) -> DataFrame:
    """AUC and recall per slice value; flagged when AUC is ``gap`` away from the whole."""
    whole = auc(df, y, p).select("auc_roc").scalar()
    long = df.select(y, p, *[F.col(s).cast("string") for s in slices]).unpivot([y, p], list(slices), "slice", "member")
    keys = ["slice", "member"]
    a = auc(long, y, p, keys)
    m = classification_metrics(long, y, p, threshold, keys).select(*keys, "precision", "recall")
    out = a.join(m, keys).withColumn("overall_auc", whole)
    return out.withColumn("has_gap", F.abs(F.col("auc_roc") - F.col("overall_auc")) > gap)


def fairness(df: DataFrame, attr: str, y: str, yhat: Column) -> DataFrame:
    """Selection rate, TPR and FPR per member, and each one's gap to the best member."""
    pos, neg = F.col(y) == 1, F.col(y) == 0
    g = df.groupBy(attr).agg(
        F.count(F.lit(1)).alias("n"), safe_div(F.count(F.when(yhat, 1)), F.count(F.lit(1))).alias("selection_rate"),
        safe_div(F.count(F.when(pos & yhat, 1)), F.count(F.when(pos, 1))).alias("tpr"),
        safe_div(F.count(F.when(neg & yhat, 1)), F.count(F.when(neg, 1))).alias("fpr"),
    )
    top = g.agg(F.struct(F.max("selection_rate").alias("s"), F.max("tpr").alias("t"), F.min("fpr").alias("f"))).scalar()
    return g.withColumns(
        {
            "parity_gap": top["s"] - F.col("selection_rate"),
            "equalised_odds_gap": F.greatest(top["t"] - F.col("tpr"), F.col("fpr") - top["f"]),
        }
    )


# --- models -------------------------------------------------------------------------------


def stored(model: PipelineModel, df: DataFrame) -> PipelineModel:
    """Save a fitted model in the shared folder and load it back.

    A freshly fitted model drags its training summary, and with it the session, into
    every scoring task, which fails to serialise once the session has observed metrics.
    """
    path = new_path(df.sparkSession, "model")
    model.save(path)
    return PipelineModel.load(path)


def unknown(xs: Sequence[str]) -> Column:
    """A feature is NULL or NaN."""
    bad = F.lit(False)
    for x in xs:
        v = F.col(x).cast("double")
        bad = bad | v.isNull() | F.isnan(v)
    return bad


def left_out(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """How many rows a fit over ``xs`` uses and leaves out."""
    return df.agg(F.count(F.when(~unknown(xs), 1)).alias("n_used"), F.count(F.when(unknown(xs), 1)).alias("n_left_out"))


def fit_classifier(train: DataFrame, y: str, xs: Sequence[str], kind: str = "linear", seed: int = 42) -> PipelineModel:
    """Scaled logistic regression or boosted trees, fitted to rows whose features are all known."""
    parts = [VectorAssembler(inputCols=list(xs), outputCol="_raw", handleInvalid="keep")]
    if kind == "linear":
        parts += [StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="_label", maxIter=50)]
    elif kind == "boosted":
        parts.append(GBTClassifier(featuresCol="_raw", labelCol="_label", maxIter=20, maxDepth=4, seed=seed))
    else:
        raise ValueError(f"unknown model {kind!r}")
    known = train.filter(~unknown(xs)).withColumn("_label", F.col(y).cast("double"))
    return stored(Pipeline(stages=parts).fit(known), train)


def score(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Batch scores, one for every row: NULL where a feature is unknown. Helper columns are dropped."""
    xs = model.stages[0].getInputCols()
    scored = model.transform(df).withColumn(out, F.when(~unknown(xs), vector_to_array("probability")[1]))
    return scored.select(*df.columns, out)


def adversarial_auc(train: DataFrame, prod: DataFrame, xs: Sequence[str]) -> DataFrame:
    """How well a model tells training from production rows (0.5 is no drift, > 0.7 is drift)."""
    both = train.select(*xs, F.lit(0).alias("_y")).unionByName(prod.select(*xs, F.lit(1).alias("_y")))
    out = auc(score(fit_classifier(both, "_y", xs), both), "_y", "p")
    return out.withColumn("is_drifted", F.col("auc_roc") > 0.7)


PART_BITS = 12


def shuffled_column(df: DataFrame, key: str, col: str, seed: int) -> DataFrame:
    """Permute one column: rows are numbered by two hash orders and matched by number.

    ``key`` identifies a row. Hashes are even, so their first bits deal the rows into parts of like size;
    the counts of the parts carry the numbers on, and rows are shuffled once to be numbered and once to meet.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.withColumns({"_h0": F.xxhash64(key, F.lit(seed)), "_h1": F.xxhash64(key, F.lit(seed + 1)), "_tie": F.xxhash64(*plain)})
    part = [F.call_function("shiftright", F.col(f"_h{i}"), F.lit(64 - PART_BITS)) for i in (0, 1)]
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), part[i].alias("_part")) for i in (0, 1)])
    sizes = rows.select(F.inline(sides)).groupBy("_side", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_side").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = settle(sizes.select("_side", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "parts")

    def numbered(i: int, cols: Sequence[str]) -> DataFrame:
        within = W.partitionBy("_part").orderBy(f"_h{i}", key, "_tie")
        ranked = rows.withColumn("_part", part[i]).select(*cols, "_part", F.row_number().over(within).alias("_n"))
        side = before.filter(F.col("_side") == i).select("_part", "_before")
        return ranked.join(side, "_part").select(*cols, (F.col("_before") + F.col("_n")).alias("_r"))

    rest = [c for c in df.columns if c != col]
    return numbered(0, rest).join(numbered(1, [col]), "_r").select(*df.columns)


def auc_roc(df: DataFrame, y: str, p: str) -> DataFrame:
    """The ``auc_roc`` of ``auc`` alone, from the sums of each range of scores: nothing is written or joined back."""
    counts = value_counts_table(df, p, {"n": F.lit(True), "pos": F.col(y) == 1}).select((-F.col(p).cast("double")).alias("_down"), "n", "pos")

    def area(batches):
        first, n, pos, total = None, 0, 0, 0.0
        for batch in batches:
            down, n_here, pos_here = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if len(down):
                first = float(down[0]) if first is None else first
                above = pos + np.cumsum(pos_here) - pos_here  # positives of this range scored strictly higher
                total += float(((n_here - pos_here) * (above + pos_here / 2)).sum())
                n, pos = n + int(n_here.sum()), pos + int(pos_here.sum())
        if first is not None:
            yield pa.RecordBatch.from_pydict({"_first": [first], "n": [n], "pos": [pos], "area": [total]})

    dealt = counts.repartitionByRange(shuffle_width(df.sparkSession, counts), "_down").sortWithinPartitions("_down")
    ranges = dealt.mapInArrow(area, "_first double, n long, pos long, area double")
    higher = F.coalesce(F.sum("pos").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    neg = (F.col("n") - F.col("pos")).cast("double")
    out = ranges.select("n", "pos", (F.col("area") + neg * higher).alias("area"))
    return out.agg(safe_div(F.sum("area"), F.sum("pos") * (F.sum("n") - F.sum("pos"))).alias("auc_roc"))


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, y: str, xs: Sequence[str], seed: int = 42) -> DataFrame:
    """AUC lost when one feature is shuffled, per feature."""
    base = settle(auc_roc(score(model, df), y, "p"), "auc").select("auc_roc").scalar()
    parts = []
    for i, x in enumerate(xs):
        mixed = auc_roc(score(model, shuffled_column(df.select(key, y, *xs), key, x, seed + 10 * i)), y, "p")
        parts.append(mixed.select(F.lit(x).alias("feature"), (base - F.col("auc_roc")).alias("auc_drop")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def label_permutation_auc(df: DataFrame, key: str, y: str, xs: Sequence[str], seed: int = 42) -> DataFrame:
    """AUC after training on shuffled labels; far from 0.5 means leakage."""
    mixed = settle(shuffled_column(df.select(key, y, *xs), key, y, seed), "mixed")  # read by the scaler, the fit and the score
    return auc(score(fit_classifier(mixed, y, xs), mixed), y, "p")


def cluster_outcomes(df: DataFrame, xs: Sequence[str], k: int, y: str | Column, seed: int = 42) -> DataFrame:
    """K-means clusters with their size and mean outcome; rows with an unknown feature have cluster NULL."""
    prep = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(xs), outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed),
        ]
    ).fit(df.filter(~unknown(xs)))
    v = col_of(y).cast("double")
    placed = stored(prep, df).transform(df).withColumn("cluster", F.when(~unknown(xs), F.col("cluster")))
    return placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_outcome"), *[F.avg(x).alias(f"mean_{x}") for x in xs]
    )


