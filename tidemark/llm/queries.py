"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import block_max, chat, checks, decontaminate, differencing, html_text, neardup, packing, pii, quality, secret_scan, shards, spelling, token_counts
from tidemark.session import new_path, show_package, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    show_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_quality_rules")
def _(spark, folder):
    return quality.judge(table(spark, folder, "documents"))


@query("op2_minhash_neardup")
def _(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op3_chat_repair")
def _(spark, folder):
    return chat.repair(table(spark, folder, "conversations"))


@query("op4_shard_lookup", checks.SHARDING)
def _(spark, folder):
    names = [f"shard-{i:02d}" for i in range(checks.SHARDS)]
    placed = shards.place(table(spark, folder, "documents"), names, checks.SLOTS, fallback=["source", "lang", "n_chars"])
    path = new_path(spark, "shards")
    shards.write_shards(placed, path)
    return spark.read.parquet(path).select("doc_id", "slot", "shard")


@query("op5_bestfit_packing")
def _(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), path)


@query("op6_token_counts")
def _(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, folder, "documents"), path)


@query("op7_benchmark_decontamination", checks.DECONTAMINATION)
def _(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_html_extraction")
def _(spark, folder):
    return html_text.extract_pages(table(spark, folder, "pages"))


@query("op9_pii_sanitisation")
def _(spark, folder):
    return pii.report(table(spark, folder, "documents"))


@query("op10_secret_scan")
def _(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


@query("op11_spelling_variants")
def _(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_ranked_search", checks.SEARCH)
def _(spark, folder):
    return block_max.search(block_max.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


@query("op13_differencing_packing")
def _(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return differencing.pack_documents(table(spark, folder, "documents"), path)
