"""Token counts of a byte-level BPE: pre-tokens in ragged arrays, merged by rank in step.

A chunk of texts is cut into pre-tokens with array operations. Those that are new to
the task lie one after another in one array of symbols; each round finds the lowest
rank among the neighbouring pairs of every pre-token and applies it in all of them at
once, until none has a known pair. The symbols left over are the tokens.

Defined cases: a NULL or empty text has 0 bytes and 0 tokens; the special string of the
vocabulary inside a text is one token, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import ragged

OTHER, LETTER, NUMBER, BLANK = range(4)
# The white space of the split pattern, and the endings it cuts off after an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or BLANK of every code point."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((major.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = BLANK
    return table


def kind_starts(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a text starts or the kind changes."""
    start = np.ones(len(kind), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start[offsets[offsets < len(kind)]] = True
    return start


def cut_endings(points: np.ndarray, kind: np.ndarray, start: np.ndarray, offsets: np.ndarray, after_space: bool) -> None:
    """Make an apostrophe and the ending behind it one pre-token, in place.

    It does so only where the apostrophe stands alone between other kinds;
    ``after_space`` says whether it may follow a plain space.
    """
    n = len(points)
    text_end = np.zeros(n + 1, dtype=bool)
    text_end[offsets[1:]] = True
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~text_end[at + 1]]
    if not after_space:
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        at = at[first[at] | (points[at - 1] != 0x20)]
    for ending in ENDINGS:
        hit = at[at + len(ending) < n]
        for k, letter in enumerate(ending, 1):
            hit = hit[(points[hit + k] == ord(letter)) & ~text_end[hit + k]]
        start[hit + 1] = False
        rest = hit + 1 + len(ending)
        rest = rest[rest < n]
        rest = rest[(kind[rest] == LETTER) & ~text_end[rest]]
        start[rest] = True


def pretokens(flat: ragged.Flat) -> ragged.Spans:
    """Cut code points as the byte-level split pattern does; every code point is in one pre-token."""
    points, offsets = flat.data, flat.offsets
    n = len(points)
    kind = kinds()[points]
    start = kind_starts(kind, offsets)
    text_end = np.zeros(n + 1, dtype=bool)
    text_end[offsets[1:]] = True
    blank_end = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK)) + 1 if n else np.zeros(0, np.int64)
    blank_end = blank_end[~text_end[blank_end]]
    cut_endings(points, kind, start, offsets, after_space=False)
    start[blank_end - 1] = True  # the last blank leaves its run ...
    start[blank_end[points[blank_end - 1] == 0x20]] = False  # ... and, if a space, joins what follows
    starts = np.flatnonzero(start)
    return ragged.Spans(starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets))


class Merges:
    """The merge table of a vocabulary file: rank of a pair of symbols, result of a rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        self.ranks = ragged.WordTable(2 + len(pairs).bit_length())
        self.ranks.add(self._pair_hash(keys), np.arange(len(pairs)))
        shown = self._shown_bytes()
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.known = ragged.WordTable()

    @staticmethod
    def _pair_hash(keys: np.ndarray) -> np.ndarray:
        return ragged.mix(keys.astype(np.uint64)) | np.uint64(1)

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
        printable = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
        spare = iter(range(256, 512))
        return [c or chr(next(spare)) for c in printable]

    def counts(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each piece when no pair can be merged any more; ``data`` has the bytes of all pieces."""
        n, left = len(lengths), lengths.copy()
        symbols, owner = self.byte_ids[data], np.repeat(np.arange(n), lengths)
        while len(symbols) > 1:
            rank = self.ranks.find(self._pair_hash((symbols[:-1] << 20) | symbols[1:]))
            rank[(rank < 0) | (owner[1:] != owner[:-1])] = self.none
            lowest = np.full(n, self.none, dtype=np.int64)
            np.minimum.at(lowest, owner[:-1], rank)
            chosen = (rank < self.none) & (rank == lowest[owner[:-1]])
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            # of overlapping equal pairs, the first, third, fifth ... of the run
            run_start = np.concatenate(([True], np.diff(at) != 1))
            run_first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_first) % 2 == 0]
            symbols[at] = self.results[rank[at]]
            np.subtract.at(left, owner[at], 1)
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            keep &= lowest[owner] < self.none  # pieces without a pair are done
            symbols, owner = symbols[keep], owner[keep]
        return left


@functools.lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    return Merges(path)


def count_chunk(texts: pa.Array, merges: Merges) -> np.ndarray:
    flat = ragged.codepoints(texts)
    spans = pretokens(flat)
    if not len(spans.starts):
        return np.zeros(len(texts), np.int64)
    narrow = flat.data.max() < 1 << 16  # a word may get one hash in either width; they only serve the task's memory of words
    hashes = ragged.span_hashes(flat.data.astype(np.uint16) if narrow else flat.data, spans.starts, spans.ends, ragged.SECRET)
    found = merges.known.find(hashes)
    missed = np.flatnonzero(found < 0)
    if len(missed):
        distinct, index, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
        rows = missed[index]
        points, offsets = ragged.gather(flat.data, spans.starts[rows], spans.ends[rows])
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        counts = merges.counts(data, np.diff(np.concatenate(([0], np.cumsum(width)))[offsets]))
        found[missed] = counts[inverse]
        if not merges.known.room(len(distinct)):
            merges.known.clear()
        if merges.known.room(len(distinct)):
            merges.known.add(distinct, counts)
    total = np.concatenate(([0], np.cumsum(found)))
    return np.diff(total[spans.first])


def count_texts(texts: pa.Array, merges: Merges) -> np.ndarray:
    out = []
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for _, _, piece in ragged.chunks(batch):
        n = np.zeros(len(piece), np.int64)
        for special in merges.special:
            marked = pc.fill_null(pc.match_substring(piece, special), False)
            if pc.any(marked).as_py():
                # each special string is a token of its own and parts the text around it
                for row in np.flatnonzero(marked.to_numpy(zero_copy_only=False)):
                    parts = piece[row].as_py().split(special)
                    n[row] = len(parts) - 1 + count_chunk(pa.array(parts, pa.large_string()), merges).sum()
                piece = pc.if_else(marked, pa.scalar("", pa.large_string()), piece)
        out.append(n + count_chunk(piece, merges))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counter(path: str):
    """A column function: tokens of a text under the vocabulary file at ``path`` (on every executor)."""

    @F.arrow_udf(T.LongType())
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(count_texts(texts, load_merges(path)))

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counter(path)("text").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
