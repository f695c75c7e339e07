"""Search against plain Python scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import block_max

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=50):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    split = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    split = [(i, Counter(w), len(w)) for i, w in split if w]
    n_docs, n_terms = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, w, _ in split for t in w)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(LOWER))) if t in df}
        scores = []
        for i, w, n in split:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            scores.append((-sum(v * ((10**9 * w[t]) // (1000 * w[t] + 20 * m)) for t, v in asked.items() if w[t]), i is not None, i))
        found = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(found, 1)]
    return Counter(out)


def rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def zipf_texts(rng, n, longest):
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "naïve", "日本", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("block, postings, parts", [(128, 4_000_000, 2000), (4, 900, 7), (1, 200, 1)])
def test_search_is_exact_for_any_segments_and_blocks(spark, make_docs, monkeypatch, block, postings, parts):
    monkeypatch.setattr(block_max, "BLOCK", block)
    monkeypatch.setattr(block_max, "SEGMENT_POSTINGS", postings)
    rng = random.Random(block)
    texts = zipf_texts(rng, 900, 60)
    docs = list(enumerate(texts)) + [(2000 + i, texts[7]) for i in range(150)]  # copies: ties beyond k
    items = [(i, t) for i, t in enumerate(zipf_texts(rng, 30, 25))] + [(99, texts[7]), (99, texts[7])]
    index = block_max.build_index(make_docs(docs).repartition(3))
    got = block_max.search(index, spark.createDataFrame(items, "item_id long, text string"), 50, parts)
    assert rows(got) == plain(docs, items)


def test_edges(spark, make_docs):
    docs = [(1, None), (2, ""), (3, " ,;"), (4, "Alpha BETA alpha"), (None, "alpha"), (4, "Alpha BETA alpha"), (5, "É é ALPHA"), (6, "z" * 50_000), (7, "x " * 70_000 + "beta")]
    items = [(1, "alpha, beta!"), (None, "é"), (3, None), (4, "..."), (5, "absent"), (6, "z" * 50_000), (7, "x X x")]
    table = make_docs(docs).withColumns({c: F.lit(0) for c in ("segment", "term", "items", "score", "_item")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(0) for c in ("rank", "term", "doc_id", "part")})
    index = block_max.build_index(table)
    assert rows(block_max.search(index, asked)) == plain(docs, items)
    assert rows(block_max.search(index, asked, k=1)) == plain(docs, items, 1)
    none = spark.createDataFrame([], "item_id long, text string")
    assert block_max.search(index, none).isEmpty()
    assert block_max.search(block_max.build_index(make_docs([])), asked).isEmpty()
    assert block_max.search(block_max.build_index(make_docs([None, ""])), asked).isEmpty()


def test_text_ids_work(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    got = block_max.search(block_max.build_index(docs), items, k=2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [None, "a"]


def test_blocks_that_cannot_win_stay_packed(monkeypatch):
    """A common term next to a rare one: only blocks with candidates are read."""
    rng = np.random.default_rng(4)
    n = 20_000
    lengths = rng.integers(5, 50, n)
    docs = [np.sort(rng.choice(n, 60, replace=False)), np.arange(n)]
    code, doc = np.repeat([0, 1], [60, n]), np.concatenate(docs)
    tf = rng.integers(1, 4, len(doc))
    packed = block_max.pack_lists(code, doc, tf, lengths)
    m = block_max.length_part(lengths, n, int(lengths.sum()))
    columns = [packed[c] for c in ("last_doc", "most_tf", "least_n", "widths")]
    lists = [
        block_max.List(w, *[c[i].values.to_numpy() for c in columns], packed["postings"][i].as_py(), len(docs[i]), lambda x: block_max.length_part(x, n, int(lengths.sum())))
        for i, w in enumerate((6000, 20))
    ]
    found, scores = block_max.best(lists, m, np.arange(n), 50)
    assert len(lists[1].open) < 0.5 * len(lists[1].counts)
    whole = np.zeros(n, np.int64)
    for w, d, t in ((6000, docs[0], tf[:60]), (20, docs[1], tf[60:])):
        whole[d] += w * block_max.tf_part(t, m[d])
    wanted = np.lexsort((np.arange(n), -whole))[:50]
    assert found.tolist() == wanted.tolist() and scores.tolist() == whole[wanted].tolist()
