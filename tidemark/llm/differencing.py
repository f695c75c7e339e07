"""Token windows of one length by multiway differencing.

A document becomes token ids with an end id behind them. Its full windows stand alone;
what is left of it, less than a window, joins the group that its task is filling. A
group is closed when its rests fill ``windows`` windows, the last of them cut where the
last window ends, and its rests are spread by differencing: each rest starts as a
partition of its own; the two partitions whose windows differ most are merged, the
fullest window of one with the emptiest of the other, until one partition is left, with
near-equal windows. Where a window exceeds its capacity, the count of windows rises
(``near_equal``) or, as cuts are allowed here, the excess is cut off and fills the
windows that came out short (``levelled``), so that no window of a group has padding.
The rests that are left at a task's end fill whole windows in the same way and, for what
is less than one, windows of the powers of two that add up to it, which need none.

All of it happens while a task reads its documents: a group has a bounded number of
tokens, nothing is shuffled, and no window spans two tasks.

Token ids come from the ``tokenizers`` library, asked once per distinct pre-token; the
pre-tokens of a chunk are found with array operations and compared by content.

Defined cases: a NULL or empty text is the end id alone; repeated rows are packed as often
as they come; a NULL doc_id stays NULL; other columns are not read; an empty table gives
no rows. A special string of the vocabulary inside a text is its one token, as the
library does by default.
"""

from __future__ import annotations

import functools
import heapq
import math
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tidemark.llm import ragged
from tidemark.llm.token_counts import WHITE, pretokens
from tidemark.session import settle

KNOWN_TOKENS = 400_000  # pre-tokens that a task remembers
LONG_TEXT = 1 << 20  # code points of a text that are read at once, if it has blanks
ROWS_OUT = 5_000
AT_ONCE = 64  # pre-tokens asked in one text
BLANKS = frozenset(map(chr, WHITE))
CHUNK_BYTES = 1 << 21


class PretokenIds:
    """Ids of texts under a byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        marks = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = re.compile(f"({marks})") if marks else None
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _solid(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that don't end with a blank; many at a time, since a line break between two is a token of its own."""
        lines = ["\n".join([*new[at : at + AT_ONCE], ""]) for at in range(0, len(new), AT_ONCE)]
        ids, _ = self._encode(lines)
        breaks = np.flatnonzero(ids == self.line_break)
        return np.delete(ids, breaks), np.diff(breaks, prepend=-1) - 1

    def _places(self, distinct: pa.LargeStringArray) -> np.ndarray:
        """Index into ``starts`` and ``lengths`` of each pre-token; their order is that of ``known``."""
        if len(self.known) + len(distinct) > KNOWN_TOKENS:
            self.forget()
        where = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        missed = np.flatnonzero(where < 0)
        if len(missed):
            new = distinct.take(pa.array(missed)).to_pylist()
            blank = np.fromiter((s[-1] in BLANKS for s in new), bool, len(new))
            missed = np.concatenate((missed[~blank], missed[blank]))  # those of blanks alone come last
            parts = self._solid([s for s, b in zip(new, blank) if not b]), self._encode([s for s, b in zip(new, blank) if b])
            ids, sizes = (np.concatenate(p) for p in zip(*parts))
            where[missed] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.known = pa.concat_arrays([self.known, distinct.take(pa.array(missed))])
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(sizes) - sizes))
            self.lengths = np.concatenate((self.lengths, sizes))
            self.pool = np.concatenate((self.pool, ids))
        return where

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings, and the offsets of the texts among them."""
        flat = ragged.flatten(texts)
        spans = pretokens(ragged.codepoints(texts))
        if not len(spans.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        leads = np.flatnonzero((flat.data & 0xC0) != 0x80)  # the byte at which each code point begins
        cuts = np.append(leads[spans.starts], len(flat.data)).astype(np.int64)
        every = pa.LargeStringArray.from_buffers(len(spans.starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(flat.data)))
        coded = every.dictionary_encode()
        where = self._places(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.lengths[where]
        ids, before = ragged.gather(self.pool, self.starts[where], self.starts[where] + sizes)
        return ids, before[spans.first]

    def _parts(self, text: str) -> Iterator[str | int]:
        """A text as special ids and stretches between them; a long stretch parts before a blank behind
        something else, where a pre-token always ends."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.special[part]
                continue
            at = 0
            while len(part) - at > LONG_TEXT:
                gap = re.compile(r"(?<=\S) ").search(part, at + LONG_TEXT)
                if gap is None:
                    break
                yield part[at : gap.start()]
                at = gap.start()
            yield part[at:]

    def _single(self, text: str) -> np.ndarray:
        parts = [np.zeros(0, np.uint32)]
        for part in self._parts(text):
            parts.append(np.array([part], np.uint32) if isinstance(part, int) else self._plain(pa.array([part], pa.large_string()))[0])
        return np.concatenate(parts)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of the texts among them."""
        texts = texts.fill_null("")
        odd = pc.greater(pc.binary_length(texts), LONG_TEXT)
        for mark in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        if not pc.any(odd).as_py():
            return self._plain(texts)
        apart = {i: self._single(texts[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        ids, offsets = self._plain(pc.if_else(odd, pa.scalar("", pa.large_string()), texts))
        parts = [apart[i] if i in apart else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@functools.lru_cache(maxsize=2)
def load_ids(path: str) -> PretokenIds:
    return PretokenIds(path)


def _members(tree) -> list[int]:
    found, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, tuple):
            open_.extend(node)
        else:
            found.append(node)
    return found


def difference(sizes: Sequence[int], count: int) -> list[list[int]]:
    """``count`` windows (indexes into ``sizes``) with near-equal sums, by multiway differencing.

    A partition lists its windows that hold something, the fullest first; those it does not list are empty.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        overlap = max(0, len(one) + len(two) - count)  # the last windows of each meet the last of the other
        kept = len(one) - overlap
        met = [(a + b, (x, y)) for (a, x), (b, y) in zip(one[kept:], reversed(two[len(two) - overlap :]))]
        merged = sorted(one[:kept] + two[: len(two) - overlap] + met, key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == count else 0
        heapq.heappush(heap, (least - merged[0][0], number, merged))
        number += 1
    windows = [_members(tree) for _, tree in heap[0][2]] if heap else []
    return windows + [[] for _ in range(count - len(windows))]


def near_equal(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Windows without cuts: their count rises until none exceeds the capacity. No size may exceed it."""
    count = math.ceil(sum(sizes) / capacity)
    while True:
        windows = difference(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        count += 1


Piece = tuple[int, int, int]  # item, start in it, length


def levelled(sizes: Sequence[int], capacity: int) -> list[list[Piece]]:
    """Windows with cuts: what exceeds the capacity is cut off the window's longest piece and moved to short windows.

    The count of windows is the least one that holds all; if it holds exactly all, every window is full.
    """
    windows = [[(i, 0, sizes[i]) for i in w] for w in difference(sizes, math.ceil(sum(sizes) / capacity))]
    spare: list[Piece] = []
    for pieces in windows:
        excess = sum(p[2] for p in pieces) - capacity
        while excess > 0:
            at = max(range(len(pieces)), key=lambda k: pieces[k][2])
            item, start, length = pieces.pop(at)
            off = min(excess, length)
            if length > off:
                pieces.append((item, start, length - off))
            spare.append((item, start + length - off, off))
            excess -= off
    for pieces in windows:
        room = capacity - sum(p[2] for p in pieces)
        while spare and room > 0:
            item, start, length = spare.pop()
            used = min(room, length)
            pieces.append((item, start, used))
            if length > used:
                spare.append((item, start + used, length - used))
            room -= used
    return windows


def powers(sizes: Sequence[int]) -> list[list[Piece]]:
    """Windows of the powers of two that add up to all sizes, filled in order."""
    total, windows = sum(sizes), []
    bounds = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    item = start = 0
    for room in bounds:
        pieces: list[Piece] = []
        while room:
            used = min(room, sizes[item] - start)
            pieces.append((item, start, used))
            room, start = room - used, start + used
            if start == sizes[item]:
                item, start = item + 1, 0
        windows.append(pieces)
    return windows


class Group:
    """Rests of documents (document, start in it, its ids) on their way into windows."""

    def __init__(self, length: int):
        self.length, self.rests, self.total = length, [], 0

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.rests.append((doc, start, ids))
        self.total += len(ids)

    def take(self, tokens: int) -> list[tuple]:
        """The first ``tokens`` of what the group holds; a rest at the border is cut."""
        taken, left = [], tokens
        rests = iter(self.rests)
        kept = []
        for doc, start, ids in rests:
            used = min(left, len(ids))
            if used:
                taken.append((doc, start, ids[:used]))
            if used < len(ids):
                kept.append((doc, start + used, ids[used:]))
            left -= used
        self.rests, self.total = kept, self.total - tokens
        return taken

    @staticmethod
    def places(rests: list[tuple], windows: list[list[Piece]]) -> Iterator[list[tuple]]:
        for pieces in windows:
            yield [(rests[i][0], rests[i][1] + at, rests[i][2][at : at + n]) for i, at, n in sorted(pieces)]

    def full(self, windows: int) -> Iterator[list[tuple]]:
        rests = self.take(windows * self.length)
        return self.places(rests, levelled([len(r[2]) for r in rests], self.length))

    def last(self) -> Iterator[list[tuple]]:
        if self.total >= self.length:
            yield from self.full(self.total // self.length)
        if self.total:
            rests = self.take(self.total)
            yield from self.places(rests, powers([len(r[2]) for r in rests]))


def _windows(batches: Iterator[pa.RecordBatch], words: PretokenIds, length: int, end_id: int, windows: int) -> Iterator[list[tuple]]:
    """Windows as lists of (document, start, ids); a document is (doc_id, its number of tokens)."""
    group = Group(length)
    for batch in batches:
        for first, last, texts in ragged.chunks(batch, limit=CHUNK_BYTES):
            keys = batch.column(batch.schema.get_field_index("doc_id")).slice(first, last - first).to_pylist()
            ids, offsets = words.ids(texts)
            for i, key in enumerate(keys):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                doc, whole = (key, len(own)), len(own) // length * length
                for at in range(0, whole, length):
                    yield [(doc, at, own[at : at + length])]
                if whole < len(own):
                    group.add(doc, whole, own[whole:])
                    if group.total >= windows * length:
                        yield from group.full(windows)
    yield from group.last()


PLACED = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, windows: int = 32, with_ids: bool = False) -> DataFrame:
    """Pieces with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    ``windows`` is the number of windows that a group of rests fills. The result is a map
    over the documents; write it once (``pack_documents``) if rows may come in another order next time.
    """
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in PLACED]])
    schema = T.StructType(schema.fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number, kind = load_ids(path), TaskContext.get().partitionId() << 40, None
        columns: list[list] = [[] for _ in schema.fields]

        def out() -> pa.RecordBatch:
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1 : 1 + len(PLACED)]]]
            if with_ids:
                arrays.append(pa.array(columns[-1], pa.list_(pa.int64())))
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        for pieces in _windows(seen(), words, length, end_id, windows):
            offset = 0
            for (key, tokens), start, ids in pieces:
                row = [key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, number, offset]
                for column, value in zip(columns, [*row, ids.astype(np.int64)] if with_ids else row):
                    column.append(value)
                offset += len(ids)
            number += 1
            if len(columns[0]) >= ROWS_OUT:
                yield out()
        if columns[0]:
            yield out()
        words.forget()
        ragged.release()

    return docs.select("doc_id", "text").mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, windows: int = 32) -> DataFrame:
    """The pieces of ``pack``, written once, so that later reads of the result agree."""
    return settle(pack(docs, path, length, end_id, windows), "windows")


def sequences(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, windows: int = 32) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (joined in order of their places), n_pieces."""
    pieces = settle(pack(docs, path, length, end_id, windows, with_ids=True), "windows")
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_pieces"))
