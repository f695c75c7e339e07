"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs, length=7, count=2):
    found = Counter()
    for i, text in docs:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(words, times=10):
    """Words that share a copy with one letter left out are few; each such pair is compared."""
    holes = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, n in words.items():
        top = min(((-words[x], x) for x in near[w]), default=(0, None))
        form[w] = top[1] if -top[0] >= times * n and top[1] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows(df):
    found = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len({w for w, _ in found}) == len(found)
    return dict(found)


def test_query_matches_brute_force(spark, data, texts):
    got = rows(queries.QUERIES["op11_spelling_variants"](spark, data))
    want = plain_variants(plain_words(texts.items()))
    assert got == want and sum(v[3] for v in want.values()) > 100 and any(v[0] for v in want.values())


@pytest.mark.parametrize("alphabet, longest, seed", [("ab", 9, 1), ("abé", 6, 2), ("abcdefgh", 5, 3), ("a", 30, 4)])
def test_near_words_are_all_found(spark, alphabet, longest, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices(alphabet, k=rng.randrange(1, longest + 1))) for _ in range(350)}
    table = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = Counter((r["word"], r["near"]) for r in spelling.near_words(table).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_edges(spark, make_docs):
    tall = "".join(random.Random(8).choices("abcdefghij", k=3000))
    texts = [
        None, "", "short words only", "Abcdefgh abcdefgh ABCDEFGH abcdefgx abcdefgx", "ÀÉÎÕÜ×÷ Àéîõüàÿ àéîõü×÷ ÀÉÎÕÜ×÷",
        f"{tall} {tall} {tall}x {tall}x x{tall} x{tall}", "abcdefgh " * 300, "abcdefghi1abcdefghi", "a" * 50_000, "a" * 50_000,
    ]
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3]), (77, "abcdefg " * 40)]
    table = make_docs(docs).withColumns({c: F.lit(0) for c in ("word", "n", "node", "side")})
    want = plain_variants(plain_words(docs))
    assert rows(spelling.variants(table)) == want and any(v[0] for v in want.values())
    assert spelling.variants(make_docs([])).count() == 0
    assert spelling.variants(make_docs([None, ""])).count() == 0


def test_roots_follow_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4")]
    got = {r["word"]: r["root"] for r in spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w9" for w, _ in links}
