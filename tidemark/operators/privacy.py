"""Pseudonyms, masks, small-group suppression, row-level access, personal-data scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col_of
from tidemark.session import new_path

# Patterns of personal data in free text.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\+[0-9][0-9 ()-]{7,}[0-9]",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# A character every match holds, to skip texts without it.
PII_MARKERS = {"email": "@", "ipv4": ".", "phone": "+", "national_id": "-"}
BLOCK = 64


def hmac_sha256(c: Column | str, key: bytes) -> Column:
    """Keyed hash of a text column, entirely in built-in functions."""
    import hashlib

    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    text = F.encode(col_of(c).cast("string"), "UTF-8")
    first = F.sha2(F.concat(F.lit(inner), text), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def pseudonymize(df: DataFrame, cols: Sequence[str], key: bytes) -> DataFrame:
    """Replace columns by stable keyed pseudonyms; NULL stays NULL."""
    return df.withColumns({c: hmac_sha256(c, key) for c in cols})


def mask(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Letters and digits become X, x and n; the shape stays visible."""
    return df.withColumns({c: F.mask(F.col(c).cast("string")) for c in cols})


def mask_email(c: Column | str) -> Column:
    """First letter and domain only."""
    return F.regexp_replace(col_of(c), r"^(.)[^@]*@", "$1***@")


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"))


def suppress_small(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], k: int = 5) -> DataFrame:
    """Aggregate with figures of groups below ``k`` members set to NULL."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in aggs.items()])
    small = F.col("_n") < k
    shown = {n: F.when(~small, F.col(n)) for n in aggs}
    return g.withColumns({**shown, "is_suppressed": small}).drop("_n")


def k_anonymous(df: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """Drop rows whose quasi-identifier combination has fewer than ``k`` rows."""
    big = group_sizes(df, by).filter(F.col("group_size") >= k)
    right = big.select(*[F.col(c).alias(f"_r_{c}") for c in by])
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(right, cond, "left_semi")


def rls(df: DataFrame, user_map: DataFrame, user: str, col: str) -> DataFrame:
    """Rows whose ``col`` the user may see; ``user_map`` has user and value."""
    allowed = user_map.filter(F.col("user") == user).select(F.col("value").alias("_v"))
    return df.join(allowed, F.col(col) == F.col("_v"), "left_semi")


def reachable(edges: DataFrame, root: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes reachable from ``root`` (one column ``node``) with their depth; cycles are safe.

    Breadth first: every level is written to the shared folder, which cuts the
    lineage and survives lost executors. The number of jobs is the depth.
    """
    spark = edges.sparkSession
    base = new_path(spark, "reach")
    root.select(F.col(root.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct().write.parquet(f"{base}/level=0")
    links = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).filter("_s <> _d")
    for depth in count(1):
        last = spark.read.parquet(f"{base}/level={depth - 1}")
        seen = spark.read.parquet(*[f"{base}/level={i}" for i in range(depth)]).select("node")
        found = links.join(last, F.col("_s") == F.col("node")).select(F.col("_d").alias("node")).distinct()
        fresh = found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        fresh.write.parquet(f"{base}/level={depth}")
        if spark.read.parquet(f"{base}/level={depth}").isEmpty():
            return spark.read.parquet(*[f"{base}/level={i}" for i in range(depth)])


def subtree(edges: DataFrame, root: DataFrame, parent: str, child: str) -> DataFrame:
    """A manager and everyone below."""
    return reachable(edges, root, parent, child)


def pii_scan(df: DataFrame, cols: Sequence[str], patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Matches and affected rows per column and pattern, all in one pass over the whole texts."""
    rules = [(c, name, pat) for c in cols for name, pat in (patterns or PII_PATTERNS).items()]
    # count each pattern once per row, then aggregate the counts
    markers = PII_MARKERS if patterns is None else {}

    def hits_of(c, name, pat):
        n = F.regexp_count(F.col(c), F.lit(pat))
        return F.when(F.col(c).contains(markers[name]), n).otherwise(0) if name in markers else n

    counted = df.select(*[hits_of(*rule).alias(f"h{i}") for i, rule in enumerate(rules)])
    found = []
    for i, (c, name, _) in enumerate(rules):
        hits = F.col(f"h{i}")
        found.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(name).alias("pattern"), F.coalesce(F.sum(hits), F.lit(0)).alias("n_matches"),
                F.count(F.when(hits > 0, 1)).alias("n_rows"),
            )
        )
    return counted.agg(F.array(*found).alias("r")).select(F.inline("r"))
