"""Secrets in documents: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 and more characters as keys and tokens have them (8 and more
right after a =), with a digit in it, or any value assigned to a name that means a
secret: 4 and more characters in quotes, 6 without. A name and its sign are not part of
it. The forest judges its length, its make-up and changes of character class,
how likely its letter pairs are in dictionary words, how much of it dictionary words
cover, the path it comes from and the words around it. The dictionary is the corpus
itself: of the letter runs inside candidates, those that also stand as words of their
own often enough in any document. Everything is DataFrame expressions and Spark ML.

The forest is trained on labelled findings (see ``findings`` for their columns), of
which it takes at most about ``train_rows`` per class, drawn by hash. Without such a
table, ``presumed_labels`` gives the two clear kinds: varied values assigned to a name
that means a secret, and words, plain numbers, digests and examples.

Defined cases: a NULL or empty text has no candidates; rows with a NULL doc_id or path
are scanned as others; repeated rows give their findings again; without labels of both
classes every finding keeps a NULL probability and counts as a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import settle

RUN = "A-Za-z0-9+/_\\-"
KEY = f"(?<![{RUN}])(?=[A-Za-z+/_\\-]*+[0-9])(?:[{RUN}]{{16,}}+|(?<=[A-Za-z0-9_\\-]=)[{RUN}]{{8,}}+)(?:={{1,2}}+(?![{RUN}]))?+"
#: Names before a sign. Before values of any form; the first look-behind of VALUE is there to fail early.
OWNERS = (
    "(?:(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)[A-Za-z0-9_\\-]{0,20}"
    "|auth(?:orization)?(?:[_\\-][A-Za-z0-9_\\-]{0,20})?)[\"'`]?\\s{0,3}[=:]>?\\s{0,3}(?:bearer\\s{1,3})?|bearer\\s{1,3}"
)
QUOTED = f"(?<=[\"'`])(?<=(?i:{OWNERS})[\"'`])[^\\s\"'`]{{4,}}+(?=[\"'`])"
BARE = f"(?<=[=:>\\s])(?<=[=:rR]>?\\s{{0,3}})(?<=(?i:{OWNERS}))(?!(?i:bearer\\s))[^\\s\"'`,;&<>=:(){{}}\\[\\]][^\\s\"'`,;&<>(){{}}\\[\\]]{{5,}}(?<![.:?])"
CANDIDATE = f"{QUOTED}|{BARE}|{KEY}"
NAMES = "(?i)(token|secret|passw(or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|auth)"
HARMLESS = "(?i)(example|sample|dummy|test|placeholder|changeme|your[_ -])"
DIGEST_WORDS = "(?i)(sha[0-9]*|md5|commit|checksum|digest|uuid|revision|hash)"
TEST_PATH = "(?i)(test|spec|fixture|mock|example|sample|doc)"
CONFIG_PATH = "(?i)(config|settings|\\.env|secret|deploy|\\.ya?ml|\\.ini|\\.properties)"
ASSIGNED = "[=:]>?\\s*[\"'`]?$"
NEAR = 48  # characters of context on each side
FEATURES = [
    "length", "digits", "uppers", "changes", "pair_score", "coverage", "test_path", "config_path", "named", "assigned",
    "quoted", "harmless", "digest_word",
]


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, finding_no, start (code points), candidate, before and after of every candidate."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.col(path).cast("string").alias("path"), text.alias("t"))
    found = found.withColumn("found", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))).filter(F.size("found") > 0)
    found = found.withColumn("gaps", F.split("t", CANDIDATE, -1)).drop("t")
    sizes = F.transform("found", lambda c, i: F.char_length(c) + F.char_length(F.get("gaps", i)))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    found = found.withColumn("ends", ends).select("*", F.posexplode("found").alias("finding_no", "candidate"))
    gap = F.get("gaps", F.col("finding_no"))
    return found.select(
        "doc_id",
        "path",
        "finding_no",
        (F.get("ends", F.col("finding_no")) + F.char_length(gap)).cast("long").alias("start"),
        "candidate",
        # a candidate just before may be the name of this one
        F.right(F.concat(F.coalesce(F.get("found", F.col("finding_no") - 1), F.lit("")), gap), F.lit(NEAR)).alias("before"),
        F.left(F.get("gaps", F.col("finding_no") + 1), F.lit(NEAR)).alias("after"),
    )


def dictionary(docs: DataFrame, candidates: DataFrame, least: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """(piece): letter runs of candidates that stand as words of their own at least ``least`` times in the corpus."""
    runs = F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0)))
    pieces = settle(candidates.select("candidate").distinct().select(runs.alias("piece")).distinct(), "pieces")
    few = pieces.count() <= broadcast_rows
    # the outer form: the planner would else split each text twice
    words = docs.select(F.split(F.lower("text"), "[^a-z0-9]+").alias("w")).select(F.explode_outer("w").alias("piece"))
    counted = words.join(F.broadcast(pieces) if few else pieces, "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least).select("piece")


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, 2))


def spelling(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidate, pair_score and coverage of every distinct candidate.

    pair_score: mean log2 probability of its character pairs among those of dictionary
    words, with one added to each count. The pair table has at most 37 * 37 rows.
    """
    distinct = candidates.select("candidate").distinct()
    counts = known.select(F.explode(_pairs(F.col("piece"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts.filter(F.length("pair") == 2), "pairs")
    total = (counts.agg(F.sum("n")).first()[0] or 0) + 37 * 37
    lowered = F.regexp_replace(F.lower("candidate"), "[^a-z0-9]", "-")
    made = distinct.select("candidate", F.explode(_pairs(lowered)).alias("pair")).join(F.broadcast(counts), "pair", "left")
    chance = (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total))
    scored = made.groupBy("candidate").agg(F.avg(F.log2(chance)).alias("pair_score"))
    runs = F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0)))
    covered = distinct.select("candidate", runs.alias("piece")).join(known, "piece").groupBy("candidate")
    covered = covered.agg(F.sum(F.char_length("piece")).alias("letters"))
    share = F.coalesce("letters", F.lit(0)) / F.char_length("candidate")
    return scored.join(covered, "candidate", "left").select("candidate", "pair_score", share.alias("coverage"))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.char_length("candidate")


def featured(found: DataFrame, spelled: DataFrame) -> DataFrame:
    """The findings with the FEATURES as doubles."""
    change = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    around = F.concat_ws(" ", "before", "after")
    flags = {
        "test_path": F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)),
        "config_path": F.coalesce(F.col("path").rlike(CONFIG_PATH), F.lit(False)),
        "named": F.col("before").rlike(NAMES),
        "assigned": F.col("before").rlike(ASSIGNED),
        "quoted": F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
        "harmless": around.rlike(HARMLESS),
        "digest_word": F.col("before").rlike(DIGEST_WORDS),
    }
    return (
        found.join(spelled, "candidate")
        .withColumns(
            {
                "length": F.char_length("candidate").cast("double"),
                "digits": _share("[0-9]"),
                "uppers": _share("[A-Z]"),
                "changes": F.size(F.split("candidate", change)) / F.char_length("candidate"),
            }
        )
        .withColumns({name: flag.cast("double") for name, flag in flags.items()})
    )


def presumed_labels(rows: DataFrame) -> DataFrame:
    """Adds label: 1.0 for a varied value assigned to a secret's name, 0.0 for words, numbers, digests and examples.

    Others, as random runs without a name, have none and are left out.
    """
    varied = (F.col("digits") > 0.15) & (F.col("digits") < 0.9) & (F.col("changes") > 0.15)
    sure = (F.col("named") == 1) & (F.col("assigned") == 1) & varied & (F.col("harmless") == 0) & (F.col("digest_word") == 0)
    apart = (F.col("named") == 0) | (F.col("assigned") == 0)  # words around prove nothing about a value assigned to such a name
    clear = (F.col("coverage") >= 0.5) | (F.col("digits") == 1) | (apart & ((F.col("digest_word") == 1) | (F.col("harmless") == 1)))
    return rows.withColumn("label", F.when(sure, 1.0).when(clear, 0.0)).filter(F.col("label").isNotNull())


def training_rows(labelled: DataFrame, train_rows: int) -> tuple[DataFrame, set]:
    """About ``train_rows`` distinct findings of each class at most, with the number of each as weight; the classes there are.

    Findings with equal features are one, so one that holds a third of all rows is one row; they are drawn by hash.
    """
    distinct = labelled.groupBy("label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    distinct = settle(distinct, "labelled")
    counts = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(*FEATURES, F.lit(11)), F.lit(1_000_000))
    limit = F.lit(1_000_000)
    for label, n in counts.items():
        limit = F.when(F.col("label") == label, int(1_000_000 * min(1.0, train_rows / n))).otherwise(limit)
    return distinct.filter(draw < limit), {label for label, n in counts.items() if n}


def train(labelled: DataFrame, train_rows: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 7):
    """A forest over the FEATURES, or None if only one class is labelled."""
    sample, classes = training_rows(labelled, train_rows)
    if classes != {0.0, 1.0}:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    vectors = settle(vectors.select("label", "features", "weight"), "training")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=64, weightCol="weight")
    return forest.fit(vectors)


def score(rows: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Adds probability and is_secret."""
    if model is None:
        return rows.withColumns({"probability": F.lit(None).cast("double"), "is_secret": F.lit(True)})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
    model = model.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(vectors).withColumn("probability", F.get(vector_to_array("_probability"), F.lit(1)))
    return scored.drop("_features", "_probability").withColumn("is_secret", F.col("probability") >= threshold)


def prepare(docs: DataFrame, path: str = "source", least: int = 5) -> DataFrame:
    """Every finding with its features, written once."""
    found = settle(findings(docs, path), "findings")
    spelled = spelling(found, settle(dictionary(docs, found, least), "dictionary"))
    return settle(featured(found, spelled), "featured")


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, train_rows: int = 20_000) -> DataFrame:
    """doc_id, finding_no, start, length, candidate_sha256, probability and is_secret of every finding."""
    rows = prepare(docs, path)
    model = train(labelled if labelled is not None else presumed_labels(rows), train_rows)
    return score(rows, model).select(
        "doc_id",
        "finding_no",
        "start",
        F.col("length").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        F.round("probability", 6).alias("probability"),
        "is_secret",
    )
