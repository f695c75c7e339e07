"""Bootstrap and permutation by splitting counts: work grows with replicates, not with rows.

One scan sums up the values in ``leaves`` ranges that hold equal shares of the rows. A
replicate then draws how often each range is taken, and a range's part of the sum from
its mean and variance, instead of a weight for every row:

* bootstrap: Poisson counts around the number of rows, as the row-wise Poisson bootstrap gives;
* permutation: the rows of one arm are dealt down a binary tree of ranges, each
  split hypergeometric, so both arms keep their sizes;
* rerandomisation: binomial counts.

Counts come from the normal quantile of a uniform number with the skewness term (Cornish
and Fisher), which suits ranges of 16 rows and more. A range of one value is exact. The bootstrap of
a median needs no ranges: the order statistic of a resample is the data's own at a beta
distributed rank. Uniform numbers are md5 sums of (seed, replicate, node), which other
engines repeat.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.distributions import normal_quantile
from tidemark.operators.joins import asof_join
from tidemark.operators.ordered import exact_quantiles, running_sums
from tidemark.session import settle

LEAVES = 64


def normal_draw(seed: int, replicate: Column, *node: Column) -> Column:
    """A standard normal number for (seed, replicate, node)."""
    text = F.concat_ws("/", F.lit(seed).cast("string"), *[c.cast("string") for c in (replicate, *node)])
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return normal_quantile((digits + 0.5) / F.lit(float(2**52)))


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "rep")


def _beside_leaves(reps: DataFrame, cells: DataFrame) -> DataFrame:
    """Every replicate unfolds into the ranges, of which there are at most ``leaves``."""
    every = cells.agg(F.collect_list(F.struct(*cells.columns))).scalar()
    return reps.select("*", F.inline(every))


def leaf_of(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts lie below x, by halving."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(x > cuts[middle], middle + 1 + leaf_of(x, cuts[middle + 1 :])).otherwise(leaf_of(x, cuts[:middle]))


def value_leaves(df: DataFrame, col: str, leaves: int = LEAVES) -> DataFrame:
    """leaf, c (rows), m (mean) and s2 (variance within) of ``leaves`` ranges of equal shares; NULLs are left out.

    Ties can leave a range empty; it has no row then. Written once: at most ``leaves`` rows.
    """
    rows = df.select(F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL")
    found = exact_quantiles(rows, "_v", {f"c{i}": i / leaves for i in range(1, leaves)}).first() if leaves > 1 else ()
    cuts = [c for c in found or () if c is not None]
    stats = rows.groupBy(leaf_of(F.col("_v"), cuts).cast("int").alias("leaf")).agg(F.count(F.lit(1)).alias("c"), F.avg("_v").alias("m"), F.var_pop("_v").alias("s2"))
    return settle(stats, "leaves")


def summary(reps: DataFrame, conf: float) -> DataFrame:
    a = (1 - conf) / 2
    return reps.agg(  # one row per replicate
        F.avg("stat").alias("boot_mean"), F.stddev_samp("stat").alias("boot_se"),
        F.percentile("stat", F.lit(a)).alias("ci_low"), F.percentile("stat", F.lit(1 - a)).alias("ci_high"),
    )


def bootstrap_totals(df: DataFrame, col: str, stat: str, n: int, seed: int, leaves: int = LEAVES) -> DataFrame:
    """rep and stat (mean or sum) of ``n`` Poisson bootstrap replicates."""
    cells = value_leaves(df, col, leaves)
    draws = _beside_leaves(replicates(df.sparkSession, n), cells)
    c, z = F.col("c"), normal_draw(seed, F.col("rep"), F.col("leaf"), F.lit("n"))
    w = F.greatest(F.lit(0.0), F.floor(c + F.sqrt(c) * F.col("z") + (F.col("z") * F.col("z") - 1) / 6 + 0.5).cast("double"))
    draws = draws.withColumn("z", z).withColumn("w", w)
    part = F.col("w") * F.col("m") + F.sqrt(F.col("w") * F.col("s2")) * normal_draw(seed, F.col("rep"), F.col("leaf"), F.lit("s"))
    total = F.sum(part)
    return draws.groupBy("rep").agg((F.try_divide(total, F.sum("w")) if stat == "mean" else total).alias("stat"))


def bootstrap_medians(df: DataFrame, col: str, n: int, seed: int) -> DataFrame:
    """rep and stat of ``n`` bootstrap medians: the value at a beta distributed rank.

    The ranks of all replicates lie within a few standard errors of the middle; only
    values there are counted.
    """
    rows = df.select(F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL")
    size = rows.count()
    if not size:
        return df.sparkSession.createDataFrame([], "rep long, stat double")
    z = normal_draw(seed, F.col("rep"), F.lit("median"))
    spread = 0.5 / math.sqrt(size + 2)
    at = F.lit(0.5) + F.lit(spread) * (F.col("z") - (F.col("z") * F.col("z") * F.col("z") - 3 * F.col("z")) / F.lit(4.0 * (size + 4)))
    rank = F.least(F.greatest(F.ceil(at * size), F.lit(1)), F.lit(size)).cast("long")
    reps = settle(replicates(df.sparkSession, n).withColumn("z", z).select("rep", rank.alias("rank")), "ranks")
    low, high = reps.agg(F.min("rank"), F.max("rank")).first()
    last = max(1, size - 1)
    ends = exact_quantiles(rows, "_v", {"a": max(0, low - 2) / last, "b": min(last, high) / last}).first()  # a rank more on either side
    near = rows.filter(F.col("_v").between(*ends)).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    below = rows.filter(F.col("_v") < ends["a"]).count()
    held = running_sums(near, ["_v"], {"_cum": "_n"}).select("_v", (F.col("_cum") - F.col("_n") + below + 1).alias("first"))
    return asof_join(reps, held, [], "rank", "first", ["_v"]).select("rep", F.col("_v").alias("stat"))


def _split(size: Column, left: Column, taken: Column, z: Column) -> Column:
    """Of ``taken`` rows drawn from ``size`` without return, how many come from the first ``left``."""
    share = taken * left / size
    var = F.greatest(F.lit(0.0), share * (1 - left / size) * (size - taken) / F.greatest(size - 1, F.lit(1.0)))
    skew = (size - 2 * left) * (size - 2 * taken) / (size * F.greatest(size - 2, F.lit(1.0)))  # times the deviation
    drawn = F.floor(share + F.sqrt(var) * z + skew * (z * z - 1) / 6 + 0.5)
    return F.least(F.greatest(drawn, F.lit(0.0), taken - (size - left)), taken, left)


def arm_sums(df: DataFrame, col: str, taken: int, n: int, seed: int, exact: bool, leaves: int = LEAVES) -> DataFrame:
    """rep, size and total of an arm that holds ``taken`` of all rows (about as many, unless ``exact``), drawn ``n`` times."""
    if leaves & (leaves - 1):
        raise ValueError("leaves must be a power of two")
    cells = value_leaves(df, col, leaves)
    spark = df.sparkSession
    size = cells.agg(F.sum("c")).first()[0] or 0
    if exact:
        counts = [0] * leaves
        for row in cells.select("leaf", "c").collect():  # at most ``leaves`` rows
            counts[row["leaf"]] = row["c"]
        drawn = replicates(spark, n).select("rep", F.lit(1).alias("node"), F.lit(float(taken)).alias("h"))
        width = leaves
        while width > 1:
            firsts = range(0, leaves, width)
            here = {leaves // width + i: (sum(counts[a : a + width]), sum(counts[a : a + width // 2])) for i, a in enumerate(firsts)}
            pairs = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*[F.lit(float(v)) for v in x]) for kv in here.items() for x in kv])
            drawn = drawn.withColumn("_c", pairs[F.col("node")]).withColumn("_z", normal_draw(seed, F.col("rep"), F.col("node"), F.lit("n")))
            left = F.when(F.col("_c")[0] > 0, _split(F.col("_c")[0], F.col("_c")[1], F.col("h"), F.col("_z"))).otherwise(0.0)
            drawn = drawn.withColumn("_l", left)
            halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("_l").alias("h")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("h") - F.col("_l")).alias("h")))
            drawn = drawn.select("rep", F.inline(halves))
            width //= 2
        draws = drawn.withColumn("leaf", F.col("node") - leaves).join(cells, "leaf")
    else:
        share = taken / size if size else 0.0
        draws = _beside_leaves(replicates(spark, n), cells)
        z = normal_draw(seed, F.col("rep"), F.col("leaf"), F.lit("n"))
        h = F.floor(F.col("c") * share + F.sqrt(F.col("c") * (share * (1 - share))) * F.col("_z") + (1 - 2 * share) * (F.col("_z") * F.col("_z") - 1) / 6 + 0.5)
        draws = draws.withColumn("_z", z).withColumn("h", F.least(F.greatest(h.cast("double"), F.lit(0.0)), F.col("c").cast("double")))
    c, h = F.col("c"), F.col("h")
    noise = F.sqrt(h * (c - h) / F.greatest(c - 1, F.lit(1)) * F.col("s2")) * normal_draw(seed, F.col("rep"), F.col("leaf"), F.lit("s"))
    return draws.groupBy("rep").agg(F.sum("h").alias("size"), F.sum(h * F.col("m") + noise).alias("total"))
