"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: it
starts at an offset and goes on in steps of a stride, both drawn from its name. The
shards take turns claiming their next free slot until none is free, so all own equally
many, give or take one, and when a shard comes or goes few slots change hands. A row's
key is hashed to a slot; the table is broadcast (it has ``size`` rows, which is bounded
by MOST_SLOTS), so placing a row is one look-up and no shuffle.

Defined cases: rows with a NULL key are spread by the hash of the ``fallback`` columns;
equal keys meet on one shard; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.tables import write_table

MOST_SLOTS = 1_000_003
HEX_DIGITS = 15


def _draw(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Owner of each slot, as an index into ``shards``."""
    if not is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MOST_SLOTS}")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    wish = [_draw(f"{name}/offset") % size for name in shards]
    stride = [1 + _draw(f"{name}/stride") % (size - 1) for name in shards] if size > 2 else [1] * len(shards)
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while owner[wish[shard]] >= 0:
            wish[shard] = (wish[shard] + stride[shard]) % size
        owner[wish[shard]] = shard
    return owner


def table_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard) with one row per slot."""
    rows = [(slot, shards[owner]) for slot, owner in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "slot long, shard string")


def slot_of(key: Column, size: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: Sequence[str], size: int, key: str = "doc_id", fallback: Sequence[str] = ()) -> DataFrame:
    """The rows with their slot and shard, which replace columns of these names."""
    docs = docs.drop("slot", "shard")
    text = F.coalesce(F.col(key).cast("string"), F.concat_ws("|", F.lit("no key"), *[F.col(c).cast("string") for c in fallback]))
    table = table_frame(docs.sparkSession, shards, size)
    return docs.withColumn("slot", slot_of(text, size)).join(F.broadcast(table), "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; a shard of many rows is written by several tasks."""
    write_table(placed, path, partition_by=["shard"])
