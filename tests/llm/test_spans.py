"""Spans of personal data and the sample of a fit: linear work, exact bounds."""

import random
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import pii, secret_scan

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_addresses_are_those_of_the_pattern():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choices("ab1.-@@ _é", k=draw.randint(0, 40)))
        assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)], text


def test_terms_outside_fixed_spans():
    draw = random.Random(4)
    for _ in range(500):
        fixed = sorted(("ip", s, s + draw.randint(1, 9)) for s in draw.choices(range(80), k=draw.randint(0, 8)))
        terms = [("term", s, s + draw.randint(1, 6)) for s in draw.sample(range(90), 12)]
        want = [x for x in sorted(terms, key=lambda x: x[1]) if not any(s < x[2] and x[1] < e for _, s, e in fixed)]
        assert pii.outside(terms, fixed) == want


def test_time_grows_with_the_text():
    def seconds(work, n):
        began = time.process_time()
        work(n)
        return time.process_time() - began

    for work in (
        lambda n: list(pii.emails("a@b " * n)),
        lambda n: list(pii.emails("a@" * n)),
        lambda n: pii.outside([("term", 4 * k + 2, 4 * k + 3) for k in range(n)], [("ip", 4 * k, 4 * k + 1) for k in range(n)]),
    ):
        work(100)
        assert seconds(work, 200_000) < 12 * seconds(work, 50_000) + 0.1


def test_one_finding_does_not_fill_the_sample(spark):
    """A finding that is most rows of its class is one weighted row; the bound holds and nothing is lost from the weights."""
    k = F.when(F.col("id") < 30_000, 0).otherwise(F.col("id"))
    features = {name: (k % (7 + i)).cast("double") + k * 1e-6 for i, name in enumerate(secret_scan.FEATURES)}
    labelled = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("label"), *[f.alias(n) for n, f in features.items()])
    sample, classes = secret_scan.training_rows(labelled, 1_000)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert classes == {0.0, 1.0} and all(800 < n < 1_200 for n in sizes.values())
    whole, _ = secret_scan.training_rows(labelled, 1_000_000)
    assert whole.agg(F.sum("weight")).first()[0] == 40_000 and whole.count() == 10_002
