"""Hashes that no built text breaks, lost prints, column names with dots, shards written whole."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontaminate, neardup, packing, queries, ragged, token_counts


def thue_morse(a, b, n):
    """Word of 2^n letters and its complement: equal under any polynomial modulo 2^64 from 2^11 letters on."""
    word = a
    for _ in range(n):
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


def test_built_words_keep_their_own_ids(make_docs):
    left, right = thue_morse("a", "b", 11)
    for name, load in (("word_bpe_49k.json", packing.load_words), ("byte_bpe_50k.json", None)):
        path = public_tokenizers.path(name)
        wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch([left, right], add_special_tokens=False)]
        texts = pa.array([left, right], pa.large_string())
        if load:
            ids, offsets = load(path).ids(texts)
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == wanted
        else:
            assert token_counts.count_texts(texts, token_counts.load_merges(path)).tolist() == [len(w) for w in wanted]
    row = queries.quality.judge(make_docs([f"{left} x\n{right} x\n"])).first()
    assert row["n_dup_lines"] == 0


@pytest.mark.parametrize("kind", [np.uint8, np.uint32])
def test_span_hashes_follow_content_and_length(kind):
    rng = np.random.default_rng(1)
    runs = {bytes(rng.integers(0, 3, rng.integers(0, 300)).astype(np.uint8)) for _ in range(3000)}
    runs |= {bytes(n) for n in range(200)}  # zeros alone differ by length
    runs = sorted(runs)
    data = np.frombuffer(b"".join(runs) * 2, np.uint8).astype(kind)
    ends = np.cumsum([len(r) for r in runs * 2])
    starts = ends - [len(r) for r in runs * 2]
    for key in (ragged.BASE, ragged.SECRET):
        hashes = ragged.span_hashes(data, starts, ends, key)
        assert len(set(hashes.tolist())) == len(runs) and (hashes[: len(runs)] == hashes[len(runs) :]).all() and hashes.all()


def test_prints_that_a_set_lost_do_not_lose_links(monkeypatch):
    """Two sets at exactly 0.8 whose shared shingles have two pairs of equal prints."""
    shared = np.arange(1, 9, dtype=np.uint32)
    own = [np.concatenate((np.delete(shared, [2, 5]), [100 + i])).astype(np.uint32) for i in range(2)]
    group = {
        "block": np.zeros(2, np.int64), "comp": np.array([1, 2]), "id": np.array([1, 2]), "n_shingles": np.array([9, 9]),
        "signature": np.zeros((2, neardup.PLACES), np.uint16), "prints": [np.unique(o).tobytes() for o in own],
    }
    a, b, _ = neardup._links_between(group, (0, 0), 1, 80)
    assert (a.tolist(), b.tolist()) == ([1], [2])


def test_columns_with_dots(make_docs, spark):
    docs = make_docs(["alpha beta gamma delta", "clean text"]).withColumn("a.b`c", F.lit(1))
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    left = decontaminate.drop_documents(docs, items)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [1]
    assert decontaminate.drop_spans(docs, items).count() == 2


def test_shards_hold_whole_documents(spark, data, documents):
    got = queries.QUERIES["op4_shard_lookup"](spark, data)
    path = got.inputFiles()[0].split("/shard=")[0]
    written = spark.read.parquet(path)
    assert set(documents.columns) < set(written.columns)
    assert written.select(documents.columns).exceptAll(documents).isEmpty() and written.count() == documents.count() == got.count()
