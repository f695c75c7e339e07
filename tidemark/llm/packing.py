"""Token sequences of one length from documents of any length: bounded-space best fit.

Documents become token ids (with an end id behind each), longer ones are cut into full
pieces, and the pieces are packed. A task packs the pieces dealt to it, the long ones
first, into at most ``open_bins`` bins: a bitset has a bit for every free space that
some open bin has, so the tightest bin that fits is the lowest set bit from the piece's
length on. When one more bin would be too many, the fullest closes first. Only lengths
move through the shuffle; tasks get equal numbers of pieces, whatever their keys.

Token ids come from the ``tokenizers`` library. A word's ids don't depend on its
neighbours, so the library is asked once per distinct word and the words of a text are
found with array operations; a text with code points from U+0250 on or with a special
string goes through the library as a whole.

Defined cases: a NULL or empty text is the end id alone; repeated rows are packed as
often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tidemark.llm import ragged
from tidemark.llm.token_counts import BLANK, NUMBER, cut_endings, kind_starts, kinds
from tidemark.session import settle

FAST_BELOW = 0x250
DOTTED_CAPITAL_I = 0x130  # its lower case is two code points
WORDS_AT_ONCE = 64
WORD_END = "</w>"  # the vocabulary's mark on a word's last token


class WordIds:
    """Ids of distinct words, asked from the library once each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        lower = np.arange(FAST_BELOW, dtype=np.uint32)
        for i in range(FAST_BELOW):
            if len(chr(i).lower()) == 1:
                lower[i] = ord(chr(i).lower())
        self.lower = lower
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for word, i in vocab.items() if word.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = ragged.WordTable()
        self.lengths, self.starts, self.pool = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint32)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has; some words at a time, with spaces between, make one text."""
        text, texts = points.tobytes().decode("utf-32-le"), []
        cuts = offsets.tolist()
        for at in range(0, len(cuts) - 1, WORDS_AT_ONCE):
            part = cuts[at : at + WORDS_AT_ONCE + 1]
            texts.append(" ".join([text[a:b] for a, b in zip(part, part[1:])]))
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in done])
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def places(self, points: np.ndarray, spans: ragged.Spans) -> np.ndarray:
        """Index into ``lengths`` and ``starts`` of every word."""
        hashes = ragged.span_hashes(points.astype(np.uint16), spans.starts, spans.ends, ragged.SECRET)  # all are below FAST_BELOW
        if not self.known.room(len(hashes)):
            self.forget()
            if not self.known.room(len(hashes)):  # one text of a million words and more
                self.known = ragged.WordTable(2 + len(hashes).bit_length())
        where = self.known.find(hashes)
        missed = np.flatnonzero(where < 0)
        if len(missed):
            distinct, index, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            rows = missed[index]
            ids, lengths = self.words(*ragged.gather(points, spans.starts[rows], spans.ends[rows]))
            fresh = np.arange(len(self.lengths), len(self.lengths) + len(distinct))
            where[missed] = fresh[inverse]
            self.known.add(distinct, fresh)
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.pool = np.concatenate((self.pool, ids))
        return where

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after another, and the offsets of the texts among them."""
        flat = ragged.codepoints(texts)
        points, offsets = flat.data, flat.offsets
        odd = (points >= FAST_BELOW) | (points == DOTTED_CAPITAL_I)
        if len(points) > 1:
            odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        slow = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(odd)))[offsets]))
        points = self.lower[np.minimum(points, FAST_BELOW - 1)]
        kind = kinds()[points]
        start = kind_starts(kind, offsets)
        cut_endings(points, kind, start, offsets, after_space=True)
        start |= kind == NUMBER  # every digit is a word
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        solid = kind[starts] != BLANK
        spans = ragged.Spans(starts[solid], ends[solid], np.searchsorted(starts[solid], offsets))
        if len(slow):  # leave out the words of texts that the library reads whole
            keep = np.ones(len(texts), dtype=bool)
            keep[slow] = False
            fast = np.repeat(keep, spans.counts)
            counts = np.where(keep, spans.counts, 0)
            spans = ragged.Spans(spans.starts[fast], spans.ends[fast], np.concatenate(([0], np.cumsum(counts))))
        where = self.places(points, spans) if len(spans.starts) else np.zeros(0, np.int64)
        lengths = self.lengths[where]
        before = np.concatenate(([0], np.cumsum(lengths)))
        ids, _ = ragged.gather(self.pool, self.starts[where], self.starts[where] + lengths)
        offsets = before[spans.first]
        if len(slow):
            whole = dict(zip(slow.tolist(), self.encode([texts[i].as_py() for i in slow.tolist()])))
            parts = [np.array(whole[i], np.uint32) if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, offsets


@functools.lru_cache(maxsize=2)
def load_words(path: str) -> WordIds:
    return WordIds(path)


def cut(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = [docs.schema["doc_id"], *[T.StructField(n, t) for n, t in PIECE]]
    schema = T.StructType(schema + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_words(path)
        for batch in batches:
            for first, last, texts in ragged.chunks(batch):
                keys = batch.column(batch.schema.get_field_index("doc_id")).slice(first, last - first)
                ids, offsets = words.ids(texts.fill_null(""))
                row, number, start, size, crc, kept = [], [], [], [], [], []
                for i in range(len(texts)):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), length)):
                        part = own[at : at + length]
                        row.append(i), number.append(k), start.append(at), size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int64))
                columns = [keys.take(pa.array(row, pa.int64()))]
                columns += [pa.array(v, pa.int32() if v is number else pa.int64()) for v in (number, start, size, crc)]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
        words.forget()
        ragged.release()

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


class BestFit:
    """Open bins by free space. ``place`` gives (bin, offset) of a piece."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.n_open = self.next_bin = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return taken

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            target = self._take(free)
        else:
            free, target = self.length, self.next_bin
            self.next_bin += 1
        left = free - size
        if left:
            if self.n_open >= self.open_bins:  # the fullest of the open ones closes
                tightest = (self.bits & -self.bits).bit_length() - 1
                if tightest <= left:
                    self._take(tightest)
                else:
                    return target, self.length - free
            self.by_free[left].append(target)
            self.bits |= 1 << left
            self.n_open += 1
        return target, self.length - free


def fill(pieces: DataFrame, length: int = 4096, open_bins: int = 16_384, tokens_per_task: int = 1 << 27) -> DataFrame:
    """Add sequence_id and offset. ``pieces`` should be a written table: it is read twice, once for its sum of lengths."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / tokens_per_task))
    names = pieces.columns
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(length, open_bins)
        for batch in batches:
            task = batch.column(len(names)).to_numpy(zero_copy_only=False)
            sizes = batch.column(names.index("length")).to_pylist()
            spots = [bins.place(size) for size in sizes]
            sequence = (task.astype(np.int64) << 40) + np.array([s for s, _ in spots], dtype=np.int64)
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array([o for _, o in spots], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    dealt = pieces.repartition(tasks).withColumn("_task", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(F.desc("length"), "ids_crc32", "start")
    return dealt.mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, open_bins: int = 16_384) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The places are written once, so that later reads of the result agree.
    """
    pieces = settle(cut(docs, path, length, end_id), "pieces")
    return settle(fill(pieces, length, open_bins), "packed")


def sequences(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, open_bins: int = 16_384) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (joined in order of their places), n_pieces."""
    pieces = settle(cut(docs, path, length, end_id, with_ids=True), "pieces")
    packed = fill(pieces, length, open_bins).select("sequence_id", F.struct("offset", "ids").alias("part"))
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_pieces"))
