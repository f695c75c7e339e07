"""Benchmark passages in documents: a hash set of item n-grams against every word window.

The distinct windows of all items form the set. Its hash key is one word of the window,
the longest, so a document looks up each of its words once and compares ten words only
where that one agrees; every window that occurs contains its key word at a known place,
so none is missed. The set is broadcast while its row count, which is checked, stays
below ``broadcast_rows``; a larger one is joined by shuffling. Everything is a DataFrame
expression.

A document is identified by doc_id and the hash and length of its text, so repeated
rows get equal results and NULL ids work. Defined cases: a NULL or empty text has no
words and no hits; an item of fewer words than the width, and not none, is one window;
items without an id mark words but are not listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import settle

# What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10
KEY = ["_id", "_hash", "_bytes"]


def words(text: Column) -> Column:
    """Words with A-Z in lower case; lower() is faster where it changes nothing else."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, GAP), "")


def item_windows(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (gram, key word and its place) and which items have which."""
    split = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    grams = split.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), width).alias("gram"))
    longest = F.transform("gram", lambda w, i: F.struct(F.octet_length(w).alias("n"), w.alias("w"), (-i).alias("back")))
    distinct = grams.select("gram").distinct().withColumn("top", F.array_max(longest))
    return distinct.select("gram", F.col("top.w").alias("anchor"), (-F.col("top.back")).alias("place")), grams.distinct()


def identified(docs: DataFrame) -> DataFrame:
    """KEY columns and ``_row`` with all columns of the documents, whatever their names."""
    text = F.coalesce("text", F.lit(""))
    keys = [F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash"), F.octet_length(text).alias("_bytes")]
    named = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return docs.select(*keys, F.struct(*named).alias("_row"))


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(occurrences: KEY, start, end, gram; which items have which gram). Places count words from 0."""
    grams, owners = item_windows(items, width)
    if grams.limit(broadcast_rows + 1).count() <= broadcast_rows:
        grams = F.broadcast(grams)
    scanned = identified(docs.select("doc_id", "text")).select(*KEY, words(F.col("_row.text")).alias("w"))
    # the outer form: the planner would else split each text once more to leave out empty ones
    scanned = scanned.select(*KEY, "w", F.posexplode_outer("w").alias("at", "anchor"))
    met = scanned.join(grams, "anchor")
    first = F.col("at") - F.col("place")
    fits = (first >= 0) & (first + F.size("gram") <= F.size("w"))
    same = F.when(fits, F.slice("w", first + 1, F.size("gram")) == F.col("gram")).otherwise(False)
    hits = met.filter(same).select(*KEY, first.alias("start"), (first + F.size("gram")).alias("end"), "gram")
    return hits.distinct(), owners


def covered(hits: DataFrame) -> DataFrame:
    """Words of each document that lie in some occurrence: KEY, n_hit. Overlaps count once."""
    spans = hits.select(*KEY, "start", "end").distinct()
    reached = "max(end) OVER (PARTITION BY _id, _hash, _bytes ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))), F.lit(0))
    counted = spans.withColumn("before", F.expr(reached)).groupBy(*KEY)
    return counted.agg(F.sum(fresh).alias("n_hit"))


def listed(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Items that occur in each document: KEY, items (their ids as sorted strings)."""
    found = hits.select(*KEY, "gram").distinct().join(owners, "gram")
    found = found.select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))


def same_key(left: DataFrame, right: DataFrame) -> Column:
    keys = [left[k].eqNullSafe(right[k]) for k in KEY]
    return keys[0] & keys[1] & keys[2]


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    hits, owners = find(docs, items, width)
    hits = settle(hits, "hits")
    counts, names = covered(hits), listed(hits, owners)
    found = counts.join(names, same_key(counts, names), "left").select(*[counts[k] for k in KEY], "n_hit", "items")
    n_words = F.size(words(F.col("_row.text"))).cast("long").alias("n_words")
    rows = identified(docs.select("doc_id", "text")).select(*KEY, n_words)
    out = rows.join(found, same_key(rows, found), "left")
    items_ = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        rows["_id"].alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    hits, _ = find(docs, items, width)
    marked = settle(hits.select(*KEY).distinct(), "marked")
    rows = identified(docs)
    return rows.join(marked, same_key(rows, marked), "left_anti").select("_row.*")


def drop_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents; words inside an occurrence go, with what follows them up to the next word.

    An n_chars column, if there is one, is set to the new length.
    """
    hits, _ = find(docs, items, width)
    spans = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    rows = identified(docs)
    joined = rows.join(spans, same_key(rows, spans), "left").select("_row", "_spans")
    text = F.col("_row.text")
    units = F.regexp_extract_all(text, F.lit(f"{RAW_WORD}+{RAW_GAP}*"), F.lit(0))
    lies = lambda i: F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    left = F.concat(F.regexp_extract(text, f"^{RAW_GAP}*", 0), F.array_join(F.filter(units, lambda u, i: ~lies(i)), ""))
    out = joined.select(F.col("_row").withField("text", F.when(F.col("_spans").isNull(), text).otherwise(left)).alias("_row")).select("_row.*")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
