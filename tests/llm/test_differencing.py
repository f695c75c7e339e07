"""Differencing against brute force, and the packed windows against the library."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import differencing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n\n", " \n x", "don't  stop'll 'S 's", "a" * 3000, "é ü   x　", "<|endoftext|>", "a<|endoftext|> b<|endoft",
    "12345 67 ١٢", "日本語 текст", "tab\there\r\n", "x\x00y \x85z", "🙂🙂 👩‍👩‍👧", "''s 's's", " '", "...!!! ?",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library, texts, monkeypatch):
    rng = random.Random(3)
    alphabet = "ab Ré's\n\t  9.,<|>dofxtn"
    every = ODD + list(texts.values()) + ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(2000)]
    wanted = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    for long_text, known in ((1 << 20, 400_000), (40, 400_000), (1 << 20, 50)):
        monkeypatch.setattr(differencing, "LONG_TEXT", long_text)
        monkeypatch.setattr(differencing, "KNOWN_TOKENS", known)
        words = differencing.PretokenIds(PATH)
        for at in range(0, len(every), 700):
            ids, offsets = words.ids(pa.array(every[at : at + 700], pa.large_string()))
            assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == wanted[at : at + 700]


def spread(sizes, windows):
    sums = [sum(sizes[i] for i in w) for w in windows]
    return max(sums) - min(sums)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.integers(1, 3))
def test_difference_is_near_the_best_split(sizes, count):
    windows = differencing.difference(sizes, count)
    assert sorted(itertools.chain(*windows)) == list(range(len(sizes))) and len(windows) == count
    best = min(
        spread(sizes, [[i for i, own in enumerate(deal) if own == w] for w in range(count)])
        for deal in itertools.product(range(count), repeat=len(sizes))
    )
    assert best <= spread(sizes, windows) <= max(best, max(sizes))


def test_difference_of_the_textbook():
    assert spread([8, 7, 6, 5, 4], differencing.difference([8, 7, 6, 5, 4], 2)) == 2
    rng = random.Random(5)
    sizes = [rng.randrange(1, 200) for _ in range(400)]
    assert spread(sizes, differencing.difference(sizes, 40)) <= 4
    assert differencing.difference([], 2) == [[], []]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
def test_the_count_rises_until_all_fits(sizes):
    windows = differencing.near_equal(sizes, 100)
    assert sorted(itertools.chain(*windows)) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60))
def test_cuts_level_windows_and_lose_nothing(sizes):
    for windows, full in ((differencing.levelled(sizes, 100), False), (differencing.powers(sizes), True)):
        seen = defaultdict(list)
        for pieces in windows:
            total = sum(p[2] for p in pieces)
            assert 0 < total and (total & (total - 1) == 0 if full else total <= 100)
            for item, start, length in pieces:
                seen[item].append((start, length))
        for item, size in enumerate(sizes):
            at = 0
            for start, length in sorted(seen[item]):
                assert start == at and length > 0
                at += length
            assert at == size
    if sum(sizes) % 100 == 0:
        assert all(sum(p[2] for p in w) == 100 for w in differencing.levelled(sizes, 100))


def check(rows, wanted, length, end_id):
    """Each id of each document is in one piece, sequences are gapless and hold at most ``length``."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(wanted)
    for doc, own in pieces.items():
        ids, at = np.array([*wanted[doc], end_id], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_query_packs_the_library_s_ids_without_padding(spark, data, texts, library):
    rows = queries.QUERIES["op13_differencing_packing"](spark, data).collect()
    wanted = {i: e.ids for i, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    assert check(rows, wanted, 1024, 0) == 0


def test_edges(spark, make_docs, library):
    docs = make_docs([None, *ODD, "word " * 3000]).withColumns({c: F.lit(1) for c in ("start", "ids", "sequence_id")})
    wanted = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    for length, windows in ((1024, 32), (64, 4), (8, 1)):
        assert check(differencing.pack(docs, PATH, length, 7, windows).collect(), wanted, length, 7) == 0
    one = differencing.sequences(docs.repartition(1), PATH, 64, 7, 4).collect()
    assert sum(len(r["ids"]) for r in one) == sum(len(w) + 1 for w in wanted.values()) and max(len(r["ids"]) for r in one) == 64
    twice = differencing.pack(make_docs([(None, "same text"), (None, "same text"), (3, "same text")]), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in twice if r["start"] == 0) == ["3", "None", "None"]
    assert differencing.pack_documents(make_docs([]), PATH).count() == 0
