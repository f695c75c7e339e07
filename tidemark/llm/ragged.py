"""Texts of an Arrow batch as flat numpy arrays: words, their hashes and their shingles.

Nothing here knows Spark; the operators call it inside Arrow map functions. A chunk
holds about ``CHUNK_BYTES`` of text (or one longer text), so the arrays stay small.
Words are hashed to 64 bits by their bytes; equal hashes count as equal words.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32


@functools.cache
def _trim():
    """The C library's way to give back free memory, where it has one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def release() -> None:
    """Give free memory back to the system: a reused worker would hold it through stages that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_string()) if column.type != pa.large_string() else column


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, texts) of consecutive pieces of a batch."""
    column = text_column(batch, name)
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1])
    ends = np.cumsum(sizes)
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last, column.slice(first, last - first)
        first = last


@dataclass
class Flat:
    """Bytes of consecutive texts; ``offsets`` has one entry more than there are texts."""

    data: np.ndarray
    offsets: np.ndarray


def flatten(texts: pa.Array) -> Flat:
    """A NULL text counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[raw[0] : raw[-1]] if body is not None else np.zeros(0, np.uint8)
    return Flat(data, raw - raw[0])


def codepoints(texts: pa.Array) -> Flat:
    """Code points (uint32) and the offsets of the texts among them."""
    flat = flatten(texts)
    points = np.frombuffer(flat.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    leads = np.concatenate(([0], np.cumsum((flat.data & 0xC0) != 0x80)))
    return Flat(points, leads[flat.offsets])


@dataclass
class Spans:
    """Runs of bytes: [start, end), and per text the position of its first run."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(member: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of members that don't cross from one text into the next."""
    n = len(member)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n:
        before[1:], after[:-1] = member[:-1], member[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner], after[inner - 1] = False, False
    starts = np.flatnonzero(member & ~before)
    return Spans(starts, np.flatnonzero(member & ~after) + 1, np.searchsorted(starts, offsets))


def words(flat: Flat) -> Spans:
    return runs(~SPACE[flat.data], flat.offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A key of this process: hashes made with it don't leave the task, and no text can be built to make two of them equal.
SECRET = int.from_bytes(os.urandom(8), "little")
LONG_SPAN = 128  # bytes; longer runs are digested one by one


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = BASE) -> np.ndarray:
    """Hash of each run by its content and length alone, odd and so never 0.

    Runs are read eight bytes at a time, all runs at once, and every block passes through
    ``mix``. The default key is the same everywhere; ``SECRET`` suits hashes that stay in the task.
    """
    width = data.itemsize
    raw = np.frombuffer(np.ascontiguousarray(data).tobytes() + bytes(8), dtype=np.uint8)
    blocks = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, 0, (1,))  # the eight bytes from every byte on
    first, sizes = starts * width, (ends - starts) * width
    out = mix(sizes.astype(np.uint64) * np.uint64(BASE) ^ np.uint64(key))
    active, done = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN)), 0
    while len(active):
        left = sizes[active] - done
        block = blocks[first[active] + done]
        partial = left < 8
        block[partial] &= (np.uint64(1) << (8 * left[partial]).astype(np.uint64)) - np.uint64(1)
        out[active] = mix(out[active] ^ block)
        active, done = active[left > 8], done + 8
    lock = key.to_bytes(8, "little")
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        digest = hashlib.blake2b(raw[first[i] : first[i] + sizes[i]], digest_size=8, key=lock).digest()
        out[i] = int.from_bytes(digest, "little")
    return out | np.uint64(1)


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words within a text, and per text the position of its first."""
    counts = np.diff(first)
    per_text = np.maximum(counts - width + 1, 0)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out + hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    keep = np.ones(n, dtype=bool)  # a window that starts in the last width - 1 words of a text would cross its end
    for k in range(1, width):
        at = first[1:] - k
        at = at[(at >= 0) & (at < n)]
        keep[at] = False
    starts_ok = np.flatnonzero(keep)
    return mix(out[starts_ok]), np.concatenate(([0], np.cumsum(per_text)))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``window_hashes``, but a text of fewer words, and not none, has its whole sequence as one."""
    found, at = window_hashes(hashes, first, width)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return found, at
    whole = np.empty(len(short), dtype=np.uint64)
    for i, row in enumerate(short):
        part = hashes[first[row] : first[row + 1]]
        value = np.uint64(len(part))
        for h in part:
            value = mix(np.array([value], dtype=np.uint64) + h)[0]
        whole[i] = value
    per_text = np.diff(at)
    merged = np.insert(found, at[short], whole)
    per_text[short] = 1
    return merged, np.concatenate(([0], np.cumsum(per_text)))


class WordTable:
    """A bounded map from 64-bit hashes to numbers, read and filled a whole array at a time."""

    def __init__(self, bits: int = 20):
        self.size, self.mask = 1 << bits, np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        self.n = 0

    def room(self, more: int) -> bool:
        return 2 * (self.n + more) <= self.size

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(1)) & self.mask).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        rows, slots, wanted = np.arange(len(hashes)), self._slots(hashes), hashes
        while len(rows):
            held = self.keys[slots]
            same = held == wanted
            out[rows[same]] = self.values[slots[same]]
            on = np.flatnonzero(~same & (held != 0))
            rows, wanted, slots = rows[on], wanted[on], (slots[on] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not in the table yet."""
        self.n += len(hashes)
        slots = self._slots(hashes)
        while len(hashes):
            order = np.flatnonzero(self.keys[slots] == 0)
            spot, first = np.unique(slots[order], return_index=True)
            won = order[first]
            self.keys[spot], self.values[spot] = hashes[won], values[won]
            left = np.ones(len(hashes), dtype=bool)
            left[won] = False
            hashes, values, slots = hashes[left], values[left], (slots[left] + 1) & int(self.mask)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all runs, one run after another, and the offsets of the runs."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets
