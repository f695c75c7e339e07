"""Ranked lexical search: compressed block lists, MaxScore with block maxima, shard heaps merged.

``build_index`` reads the documents once. Every task cuts what it reads into segments of
a bounded number of postings and writes, per segment and term, a list of blocks: document
gaps and term counts at the smallest byte width that the block needs, and beside them
the block's last document, its largest count and its shortest document. One more row of
a segment holds the ids and lengths of its documents.

``search`` joins the lists of the query terms with the items that ask for them and
evaluates each (segment, part of the items) on its own. The bound of a list or block is the
score of its largest count in its shortest document. Lists are taken in order of their
bounds: while documents could still enter the best ``k`` on the lists that are left alone,
the next one is essential and read whole; from then on the lists only add to the
candidates found, and a candidate whose score, block maximum and remaining bounds stay
below the k-th best score goes before its block is unpacked. The best ``k`` of all
segments are merged by a rank per item. Nothing is approximate.

Defined cases: a NULL or empty text has no terms, is not counted and never found; items
without terms give no rows; repeated rows of documents or items count as rows of their own;
NULL ids come first among equal scores; other columns are not read; without documents or
items there are no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.llm import ragged
from tidemark.session import settle

# What may not stand in a term, the letters lowered, and the constants of the score.
NO_TERM = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, LENGTH_SHARE = 1_000_000_000, 50

BLOCK = 128
SEGMENT_POSTINGS, SEGMENT_BYTES = 4_000_000, 64 << 20
ROWS_OUT = 10_000
IN_TERM = np.ones(256, dtype=bool)
IN_TERM[NO_TERM] = False


def tf_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 20 * m)


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms


class Segment:
    """Postings of consecutive documents until they are written."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.postings = [], [], [], []
        self.n_docs = self.n_postings = self.n_terms = self.bytes = 0

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        flat = ragged.flatten(texts)
        spans = ragged.runs(IN_TERM[flat.data], flat.offsets)
        n = len(spans.starts)
        if not n:
            return
        lowered = ragged.UPPER_TO_LOWER[flat.data]
        cuts = np.empty(2 * n, np.int64)
        cuts[0::2], cuts[1::2] = spans.starts, spans.ends
        # every second string is a term, those between are what parts them
        coded = pa.LargeStringArray.from_buffers(2 * n - 1, pa.py_buffer(cuts), pa.py_buffer(lowered)).dictionary_encode()
        code = coded.indices.to_numpy()[0::2].astype(np.int64)
        held = np.flatnonzero(spans.counts)
        place = np.zeros(len(spans.counts), np.int64)
        place[held] = np.arange(len(held))
        size = len(coded.dictionary)
        pair, tf = np.unique(place[spans.owners()] * size + code, return_counts=True)
        self.postings.append((pair % size + self.n_terms, pair // size + self.n_docs, tf))
        self.terms.append(coded.dictionary)
        self.ids.append(keys.take(pa.array(held)))
        self.lengths.append(spans.counts[held])
        self.n_terms, self.n_docs, self.n_postings = self.n_terms + size, self.n_docs + len(held), self.n_postings + len(pair)
        self.bytes += len(flat.data)

    def full(self) -> bool:
        return self.n_postings >= SEGMENT_POSTINGS or self.bytes >= SEGMENT_BYTES

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.n_docs:
            return
        lengths = np.concatenate(self.lengths)
        ids = pa.concat_arrays(self.ids)
        one = {"segment": [number], "doc_ids": pa.ListArray.from_arrays([0, len(ids)], ids), "lengths": [lengths]}
        yield pa.RecordBatch.from_arrays([pa.array(one[f.name], f.type) if f.name in one else pa.nulls(1, f.type) for f in schema], schema=schema)
        every = pa.concat_arrays(self.terms).dictionary_encode()
        code = every.indices.to_numpy()[np.concatenate([p[0] for p in self.postings])].astype(np.int64)
        doc, tf = (np.concatenate([p[k] for p in self.postings]) for k in (1, 2))
        self.postings.clear()
        used, code = np.unique(code, return_inverse=True)  # what parts terms is left out
        order = np.argsort(code * self.n_docs + doc)
        code, doc, tf = code[order], doc[order], tf[order]
        packed = pack_lists(code, doc, tf, lengths)
        terms = every.dictionary.take(pa.array(used)).cast(pa.string())
        for at in range(0, len(used), ROWS_OUT):
            part = {name: column.slice(at, ROWS_OUT) for name, column in packed.items()} | {"term": terms.slice(at, ROWS_OUT)}
            rows = len(part["term"])
            part["segment"] = pa.array(np.full(rows, number))
            yield pa.RecordBatch.from_arrays([part[f.name].cast(f.type) if f.name in part else pa.nulls(rows, f.type) for f in schema], schema=schema)


def byte_width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def pack_lists(code: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
    """Columns of the lists of terms 0, 1, 2, ...; the postings are sorted by term and document."""
    n = len(code)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    sizes = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, sizes)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] + 1
    starts = np.flatnonzero(place % BLOCK == 0)
    ends = np.append(starts[1:], n)
    counts = ends - starts
    wide, deep = byte_width(np.maximum.reduceat(gap, starts)), byte_width(np.maximum.reduceat(tf, starts))
    base = np.concatenate(([0], np.cumsum(counts * (wide + deep))))
    inside = np.arange(n) - np.repeat(starts, counts)
    out = np.zeros(base[-1], np.uint8)
    at = np.repeat(base[:-1], counts)
    for values, width, skip in ((gap, wide, 0), (tf, deep, np.repeat(counts * wide, counts))):
        width = np.repeat(width, counts)
        spot = at + skip + inside * width
        for k in range(4):
            use = width > k
            out[spot[use] + k] = (values[use] >> (8 * k)) & 0xFF
    blocks = np.concatenate(([0], np.cumsum(-(-sizes // BLOCK))))
    listed = lambda values: pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), pa.array(values, pa.int32()))
    return {
        "n_docs": pa.array(sizes, pa.int32()),
        "last_doc": listed(doc[ends - 1]),
        "most_tf": listed(np.maximum.reduceat(tf, starts)),
        "least_n": listed(np.minimum.reduceat(lengths[doc], starts)),
        "widths": listed(wide * 8 + deep),
        "postings": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(base[blocks].astype(np.int64)), pa.py_buffer(out)]),
    }


def index_schema(doc_id: T.StructField) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    fields = [("segment", T.LongType()), ("term", T.StringType()), ("n_docs", T.IntegerType())]
    fields += [(n, ints) for n in ("last_doc", "most_tf", "least_n", "widths")] + [("postings", T.BinaryType())]
    fields += [("doc_ids", T.ArrayType(doc_id.dataType)), ("lengths", ints)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def build_index(docs: DataFrame) -> DataFrame:
    """The index as a written table: a row per segment and term, and one per segment with its documents (term NULL)."""
    schema = index_schema(docs.schema["doc_id"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment, arrow = TaskContext.get().partitionId() << 32, Segment(), None
        for batch in batches:
            at = batch.schema.get_field_index("doc_id")
            if arrow is None:
                ints = pa.list_(pa.int32())
                arrow = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n_docs", pa.int32()), ("last_doc", ints), ("most_tf", ints),
                                   ("least_n", ints), ("widths", ints), ("postings", pa.binary()), ("doc_ids", pa.list_(batch.column(at).type)), ("lengths", ints)])
            for first, last, texts in ragged.chunks(batch):
                segment.add(batch.column(at).slice(first, last - first), texts)
                if segment.full():
                    yield from segment.rows(number, arrow)
                    number, segment = number + 1, Segment()
        if arrow is not None:
            yield from segment.rows(number, arrow)
        ragged.release()

    return settle(docs.select("doc_id", "text").mapInArrow(build, schema), "index")


class List:
    """A term's blocks in one segment; they are unpacked one by one, when first asked for."""

    def __init__(self, weight: int, last_doc, most_tf, least_n, widths, postings: bytes, n_docs: int, length_of):
        self.weight, self.last_doc, self.data = weight, last_doc.astype(np.int64), postings
        self.bounds = weight * tf_part(most_tf.astype(np.int64), length_of(least_n.astype(np.int64)))
        self.bound = int(self.bounds.max())
        self.wide, self.deep = widths // 8, widths % 8
        self.counts = np.full(len(widths), BLOCK)
        self.counts[-1] = n_docs - BLOCK * (len(widths) - 1)
        self.base = np.concatenate(([0], np.cumsum(self.counts * (self.wide + self.deep))))
        self.open: dict[int, tuple] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            count, at, wide = int(self.counts[k]), int(self.base[k]), int(self.wide[k])
            gaps = np.frombuffer(self.data, f"<u{wide}", count, at)
            tf = np.frombuffer(self.data, f"<u{int(self.deep[k])}", count, at + count * wide)
            before = self.last_doc[k - 1] if k else -1
            self.open[k] = before + np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)
        return self.open[k]

    def read(self, blocks: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(int(k)) for k in blocks]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def best(lists: list[List], m: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents (numbers in the segment) with scores above 0, and the scores; ``order`` ranks equal ones."""
    lists = sorted(lists, key=lambda own: -own.bound)
    rest = [0] * (len(lists) + 1)
    for i in range(len(lists) - 1, -1, -1):
        rest[i] = rest[i + 1] + lists[i].bound
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for i, own in enumerate(lists):
        if rest[i] >= least:  # essential: a document of the lists from here on could still be among the best
            found, tf = own.read(range(len(own.counts)))
            both = np.concatenate((docs, found))
            docs, inverse = np.unique(both, return_inverse=True)
            added = np.zeros(len(docs), np.int64)
            added[inverse[: len(scores)]] = scores
            added[inverse[len(scores) :]] += own.weight * tf_part(tf, m[found])
            scores = added
        else:
            near = np.searchsorted(own.last_doc, docs)
            bound = np.append(own.bounds, 0)[near]
            keep = scores + bound + rest[i + 1] >= least  # the others go before their blocks are unpacked
            docs, scores, near = docs[keep], scores[keep], near[keep]
            blocks = np.unique(near[near < len(own.counts)])
            if len(blocks):
                found, tf = own.read(blocks)
                at = np.minimum(np.searchsorted(found, docs), len(found) - 1)
                hit = found[at] == docs
                scores[hit] += own.weight * tf_part(tf[at[hit]], m[docs[hit]])
        if len(scores) >= k:
            least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    keep = scores >= least
    docs, scores = docs[keep], scores[keep]
    top = np.lexsort((order[docs], -scores))[:k]
    return docs[top], scores[top]


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def search(index: DataFrame, items: DataFrame, k: int = 50, items_at_once: int = 2_000) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents.

    Items are dealt into parts of about ``items_at_once``, so that one evaluation holds a segment's
    lists and one part of the items.
    """
    n_docs, n_terms = index.filter("term IS NULL").agg(
        F.sum(F.size("lengths").cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))
    ).first()  # two numbers
    asked = settle(items.select("item_id", terms(F.col("text")).alias("terms"), F.monotonically_increasing_id().alias("_item")), "items")
    parts = max(1, math.ceil(asked.count() / items_at_once))
    pairs = asked.select("_item", F.pmod(F.xxhash64("_item"), F.lit(parts)).alias("part"), F.explode("terms").alias("term"))
    met = settle(index.join(pairs.select("term").distinct(), "term", "left_semi"), "lists")
    share = (F.lit(2 * (n_docs or 0) + 2) / (2 * F.col("df") + 1)).cast("double")
    weights = met.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", F.floor(1000 * F.log(share)).cast("long").alias("weight"))
    wanted = pairs.groupBy("term", "part").agg(F.collect_list("_item").alias("items")).join(weights, "term")
    wanted = settle(wanted, "wanted")
    columns = ["segment", "part", "items", "weight", "n_docs", "last_doc", "most_tf", "least_n", "widths", "postings", "doc_ids", "lengths"]
    lists = met.join(wanted, "term").select(columns)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    owners = index.filter("term IS NULL").select("segment", every, "doc_ids", "lengths")
    rows = lists.unionByName(owners, allowMissingColumns=True)
    doc_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("_item", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])

    def evaluate(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        alone = pc.index(pc.is_null(table["items"]), True).as_py()
        held = table.slice(alone, 1).to_pydict()
        ids = table["doc_ids"].chunk(0).slice(alone, 1).flatten()
        m = length_part(np.array(held["lengths"][0], np.int64), n_docs, n_terms)
        order = np.empty(len(ids), np.int64)
        order[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        per_item: dict[int, list[List]] = defaultdict(list)
        length_of = lambda n: length_part(n, n_docs, n_terms)
        arrays = {c: table[c].chunk(0) for c in ("last_doc", "most_tf", "least_n", "widths")}
        for i, own in enumerate(zip(table["items"].to_pylist(), table["weight"].to_pylist(), table["postings"].to_pylist(), table["n_docs"].to_pylist())):
            if own[0] is None or own[1] <= 0:
                continue
            blocks = [a[i].values.to_numpy() for a in arrays.values()]
            made = List(own[1], *blocks, own[2], own[3], length_of)
            for item in own[0]:
                per_item[item].append(made)
        items_out, docs_out, scores_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, own in per_item.items():
            docs, scores = best(own, m, order, k)
            items_out.append(np.full(len(docs), item))
            docs_out.append(docs), scores_out.append(scores)
        found = [np.concatenate(x) for x in (items_out, docs_out, scores_out)]
        return pa.table([pa.array(found[0]), ids.take(pa.array(found[1])), pa.array(found[2])], names=schema.names)

    heaps = rows.groupBy("segment", "part").applyInArrow(evaluate, schema)
    ranked = heaps.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
