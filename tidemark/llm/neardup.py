"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set of word shingles becomes a signature of ``CHUNKS * WIDTH`` b-bit
minima. Two sets of similarity J differ in about a share 1 - J of them; the number of
differing places is the signature distance. Signatures are split into chunks, and each
chunk is entered once per place it may be wrong in (that place left out). By pigeonhole
all pairs that differ in fewer than ``2 * CHUNKS`` places share an entry, and of pairs
at a similarity of exactly 0.8 about one in a million shares none.

Entries with thousands of members never become all pairs. Documents with equal sets are
one class from the start. First every member meets the smallest member of its entry;
links are confirmed on full shingle sets and merged into components. Then members of
one entry that are still in different components are compared in blocks of bounded
size, on all their shingles as 32-bit prints, and one link for each two components
leaves the block. A component with many members in an entry has blocks of its own, which
never meet each other. So a group of copies costs about one pair a member, also with
strangers among it, and no pair in an entry is skipped unless its two documents are
already in one component or cannot be similar enough: by their sizes, or by a signature
distance over ``MAX_DISTANCE``, six deviations from what a similarity of 0.8 gives.

Shingles are compared as 64-bit hashes. Defined cases: a document without words is
linked with nothing; with fewer words than a shingle, its whole sequence is one. Rows
without a doc_id carry the component of documents with an equal set, if there are any,
and are else kept. Repeated rows get equal results. A document is a node by its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm import ragged
from tidemark.llm.links import roots
from tidemark.session import settle

CHUNKS, WIDTH = 10, 5
PLACES = CHUNKS * WIDTH
MAX_DISTANCE = 27
BLOCK = 512
_random = np.random.default_rng(20_240_501)
FLIPS = _random.integers(0, 1 << 63, PLACES, dtype=np.uint64)
FACTORS = _random.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, with repeats, and their offsets."""
    flat = ragged.flatten(texts)
    data = ragged.UPPER_TO_LOWER[flat.data]
    words = ragged.words(flat)
    return ragged.shingles(ragged.span_hashes(data, words.starts, words.ends), words.first, width)


def distinct_by_text(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that are equal only for equal hashes of one text; one hash and owner for each key."""
    owners = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys, index = np.unique(ragged.mix(hashes + owners.astype(np.uint64) * np.uint64(ragged.BASE)), return_index=True)
    return keys, hashes[index], owners[index]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit minima, PLACES for each text; texts without shingles have zeros."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, PLACES), dtype=np.uint16)
    for k in range(PLACES if len(filled) else 0):
        low = np.minimum.reduceat((hashes ^ FLIPS[k]) * FACTORS[k], offsets[filled])
        out[filled, k] = ragged.mix(low).astype(np.uint16)
    return out


FEATURES = [
    T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("signature", T.BinaryType()),
]


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, size and 128-bit hash of the shingle set, and signature."""
    schema = T.StructType([docs.schema["doc_id"], *FEATURES])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in ragged.chunks(batch):
                hashes, offsets = shingle_sets(texts, width)
                _, distinct, owners = distinct_by_text(hashes, offsets)
                n = len(texts)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.zeros(n, dtype=np.uint64)
                    np.add.at(total, owners, ragged.mix(distinct ^ np.uint64(salt)))
                    sums.append(pa.array(total.view(np.int64)))
                rows = signatures(hashes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(np.bincount(owners, minlength=n)), *sums,
                        pa.array([r.tobytes() for r in rows], pa.binary()),
                    ],
                    names=schema.names,
                )
        ragged.release()

    return docs.select("doc_id", "text").mapInArrow(compute, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), PLACES)


def entries(classes: DataFrame) -> DataFrame:
    """(entry, id) of every class: each chunk with each of its places left out."""
    schema = T.StructType([T.StructField("entry", T.LongType()), T.StructField("id", classes.schema["id"].dataType)])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1)).astype(np.uint64)
            for c in range(CHUNKS):
                chunk = rows[:, c * WIDTH : (c + 1) * WIDTH]
                for out in range(WIDTH):
                    packed = np.zeros(len(rows), dtype=np.uint64)
                    for k in range(WIDTH):
                        if k != out:
                            packed = (packed << np.uint64(16)) | chunk[:, k]
                    variant = ragged.mix(np.array([c * WIDTH + out + 1], dtype=np.uint64))[0]
                    key = ragged.mix(packed ^ variant)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=schema.names)
        ragged.release()

    return classes.select("id", "signature").mapInArrow(compute, schema)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures and sizes leave the similarity open."""
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
            near = pa.array(apart <= MAX_DISTANCE)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], names=schema.names)

    of = lambda name: classes.select(F.col("id").alias(name), F.col("signature").alias(f"s{name}"), F.col("n_shingles").alias(f"n{name}"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(fits).select("a", "b", "sa", "sb").mapInArrow(compute, schema)


def some_texts(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text) of the ids (a written table), written. The ids are broadcast while
    their count, which is checked, stays below ``broadcast_rows``."""
    few = ids.count() <= broadcast_rows
    return settle(docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have ``percent`` of their union in common. ``pairs`` is a written table.

    Only texts that occur in a pair are moved.
    """
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    wanted = settle(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).select(F.col("a").alias("doc_id")).distinct(), "wanted")
    texts = some_texts(docs, wanted)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, left in ragged.chunks(batch, "ta"):
                right = ragged.text_column(batch, "tb").slice(first, last - first)
                (ka, _, oa), (kb, _, ob) = (distinct_by_text(*shingle_sets(side, width)) for side in (left, right))
                n = last - first
                _, at, _ = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                both = np.bincount(oa[at], minlength=n)
                union = np.bincount(oa, minlength=n) + np.bincount(ob, minlength=n) - both
                linked = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, n).filter(linked) for i in (0, 1)], names=schema.names
                )
        ragged.release()

    of = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(compute, schema)


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Signature distance of every row of ``left`` from every row of ``right``."""
    if left.shape[0] * right.shape[0] < 5_000:
        return (left[:, None, :] != right[None, :, :]).sum(axis=2)
    out = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(PLACES):
        out += left[:, k][:, None] != right[:, k][None, :]
    return out


def prints(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, prints) of some documents: their distinct shingles as sorted 32-bit numbers."""
    schema = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("prints", T.BinaryType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in ragged.chunks(batch):
                hashes, offsets = shingle_sets(texts, width)
                low = (hashes >> np.uint64(16)).astype(np.uint32)
                sets = [np.unique(low[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sets, pa.binary())], names=schema.names)

    return settle(some_texts(docs, ids).mapInArrow(compute, schema), "prints")


def common(sets: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many prints the sets of each pair have in common, by bit rows over the prints that several sets have."""
    used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    own = [np.frombuffer(sets[k], dtype=np.uint32) for k in used.tolist()]
    rows = np.repeat(np.arange(len(own)), [len(o) for o in own])
    values, column, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    keep = n[column] > 1
    width = -(-int((n > 1).sum()) // 64)
    bits = np.zeros((len(own), max(width, 1)), dtype=np.uint64)
    rows, column = rows[keep], shared[column[keep]]
    np.bitwise_or.at(bits, (rows, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    x, y = at[: len(a)], at[len(a) :]
    out, step = np.zeros(len(a), dtype=np.int64), max(1, 4_000_000 // max(width, 1))
    for k in range(0, len(a), step):
        out[k : k + step] = np.bitwise_count(bits[x[k : k + step]] & bits[y[k : k + step]]).sum(axis=1)
    return out


def _links_between(group: dict, pair: tuple[int, int], most: int, percent: int):
    """Of each two components that meet in a block pair, the ``most`` most similar links; was any left out?"""
    left, right = np.flatnonzero(group["block"] == pair[0]), np.flatnonzero(group["block"] == pair[1])
    comps, none = group["comp"], (np.zeros(0, np.int64),) * 2
    different = comps[left][:, None] != comps[right][None, :]
    if pair[0] == pair[1]:
        different &= left[:, None] < right[None, :]
    if not different.any():
        return *none, False
    i, j = np.nonzero(different & (_apart(group["signature"][left], group["signature"][right]) <= MAX_DISTANCE))
    a, b, sizes = left[i], right[j], group["n_shingles"]
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    a, b = a[fits], b[fits]
    if not len(a):
        return *none, False
    both = common(group["prints"], a, b)
    # equal prints of different shingles of one set hide some; as many as the lesser loss may be shared, and confirm() has the last word
    lost = sizes - np.array([len(p) // 4 for p in group["prints"]])
    both = both + np.minimum(lost[a], lost[b])
    linked = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    a, b, both = a[linked], b[linked], both[linked]
    low, high = np.minimum(comps[a], comps[b]), np.maximum(comps[a], comps[b])
    order = np.lexsort((-both, high, low))
    low, high, a, b = low[order], high[order], a[order], b[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    x, y = group["id"][a[rank < most]], group["id"][b[rank < most]]
    return np.minimum(x, y), np.maximum(x, y), bool((rank >= most).any())


def deal(parts: DataFrame) -> DataFrame:
    """(entry, p, q, id, comp, block): every member once for each pair of blocks it takes part in.

    A component with more than BLOCK members in an entry fills blocks of its own, first to
    last; they meet all blocks but each other. The small ones share the rest, which meet all.
    """
    sizes = parts.groupBy("entry", "comp").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(0)
    shared = F.when(F.col("n") > BLOCK, 0).otherwise(F.col("n"))
    n_blocks = (F.coalesce(F.sum(own), F.lit(0)) + F.ceil(F.sum(shared) / BLOCK)).cast("int")
    totals = sizes.groupBy("entry").agg(n_blocks.alias("n_blocks"), F.sum(own).cast("int").alias("n_own"))
    before = Window.partitionBy("entry").orderBy("comp")
    large = sizes.filter(F.col("n") > BLOCK).select("entry", "comp", own.cast("int").alias("width"))
    large = large.withColumn("low", (F.sum("width").over(before) - F.col("width")).cast("int"))
    rows = parts.select("entry", "id", "comp").join(totals, "entry").join(large, ["entry", "comp"], "left")
    low, width = F.coalesce("low", F.col("n_own")), F.coalesce("width", F.col("n_blocks") - F.col("n_own"))
    rows = rows.withColumn("block", (low + F.pmod(F.xxhash64("id"), width)).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda first, end: F.when(first < end, F.sequence(first, end - 1)).otherwise(none)
    high = F.col("low") + F.col("width")
    others = F.when(F.col("low").isNull(), upto(F.lit(0), F.col("n_blocks"))).otherwise(
        F.concat(upto(F.lit(0), F.col("low")), upto(high, F.col("n_blocks")))
    )
    rows = rows.withColumn("other", F.explode(others))
    pair = [F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")]
    return rows.select("entry", *pair, "id", "comp", "block")


def remaining_links(index: DataFrame, classes: DataFrame, found: DataFrame, docs: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """(a, b, more): links between different components of one entry; entries are compared in blocks.

    Entries with the same members are compared once. See ``deal`` for the blocks.
    """
    kind = classes.schema["id"].dataType
    parts = index.join(found.select(F.col("node").alias("id"), "root"), "id", "left")
    parts = parts.select("entry", "id", F.coalesce("root", "id").alias("comp"))
    members = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    split = parts.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), *members)
    split = split.filter(F.col("low") < F.col("high")).groupBy("n", "h1", "h2").agg(F.min("entry").alias("entry"))
    parts = settle(parts.join(split.select("entry"), "entry"), "open")
    sets = prints(docs, settle(parts.select(F.col("id").alias("doc_id")).distinct(), "wanted"), width)
    rows = deal(parts).join(classes.select("id", "n_shingles", "signature"), "id").join(sets, "id")
    dealt = rows.repartition("entry", "p", "q").sortWithinPartitions("entry", "p", "q", "id")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("more", T.BooleanType())])

    def compare(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Links in the groups of a sorted table, and the last group, which may go on in the next batch."""
        heads = [table.column(c).to_numpy() for c in ("entry", "p", "q")]
        edge = np.flatnonzero(np.any([h[1:] != h[:-1] for h in heads], axis=0)) + 1
        cuts = [0, *edge.tolist(), *([table.num_rows] if whole else [])]
        data = {c: table.column(c).to_numpy() for c in ("id", "comp", "block", "n_shingles")}
        data["signature"] = _matrix(table.column("signature").combine_chunks())
        data["prints"] = table.column("prints").to_pylist()
        out_a, out_b, out_more = [], [], []
        for s, e in zip(cuts, cuts[1:]):
            if e - s < 2 or (data["comp"][s:e] == data["comp"][s]).all():
                continue
            a, b, more = _links_between({c: v[s:e] for c, v in data.items()}, (heads[1][s], heads[2][s]), most, percent)
            out_a.append(a), out_b.append(b), out_more.append(np.full(len(a), more))
        columns = [pa.array(np.concatenate(x) if x else [], t) for x, t in ((out_a, pa.int64()), (out_b, pa.int64()), (out_more, pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names), table.slice(cuts[-1])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            done, held = compare(pa.concat_tables([held, table]) if held is not None else table, False)
            yield done
        if held is not None and held.num_rows:
            yield compare(held, True)[0]
        held = None
        ragged.release()

    return dealt.mapInArrow(compute, schema).groupBy("a", "b").agg(F.max("more").alias("more"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    component_id is the smallest doc_id reachable over links; kept says that it is the
    document's own. Needs whole-number doc_ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settle(features(docs, width), "features")
    sets = ["n_shingles", "set_a", "set_b"]
    known = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = settle(known.groupBy(*sets).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes")

    index = entries(classes)
    crowded = index.groupBy("entry").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = index.join(crowded, "entry").filter(F.col("id") != F.col("b")).select(F.col("b").alias("a"), F.col("id").alias("b")).distinct()
    tested = settle(likely(star, classes, percent), "pairs")
    linked = settle(confirm(tested, docs, width, percent), "links")
    found, most = roots(linked), 1
    while True:
        left = settle(remaining_links(index, classes, found, docs, width, percent, most), "remaining")
        confirmed = settle(confirm(left.select("a", "b"), docs, width, percent), "links")
        sure, n_left = confirmed.count(), left.count()
        if sure:
            linked = linked.unionByName(confirmed)
            found = roots(linked)
        # prints say too much about one pair in ten thousand; where the link told was none, others are asked for
        if sure == n_left or left.filter("more").isEmpty():
            break
        most *= 64
    placed = classes.select(*sets, "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select(*[F.col(s).alias(f"_{s}") for s in sets], F.coalesce("root", "id").alias("component_id"))
    same = [F.col(s) == F.col(f"_{s}") for s in sets]
    out = rows.drop("signature").join(placed, same, "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One document of each group, the one of smallest doc_id, with all columns. Rows that
    repeat a kept doc_id all stay; rows without a doc_id stay unless an identified document has an equal set."""
    placed = near_duplicates(docs, width, percent)
    gone = settle(placed.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
