"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Each rule looks at the counts of one document and says junk (-1), fine (+1) or nothing
(0). How often a rule says each of these about junk and about fine documents is
unknown; expectation-maximisation estimates it, and the share of fine documents, from
all documents at once. It works on the number of documents per vote pattern (at most
3 ** rules rows, whatever the input), so one map-side aggregate is all that moves.

Defined cases: a NULL or empty text has no words and fails the base test; repeated rows
each get their own, equal result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import ragged
from tidemark.session import settle

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_ends", "n_distinct_words",
)
MIN_WORDS = 50
REPEAT_SHARE = 50


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _seen_before(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: equal to an earlier one of its text; equal to any other one of its text."""
    keys = ragged.mix(hashes + owners.astype(np.uint64) * np.uint64(ragged.BASE))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_other = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    return later, any_other


def count_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    flat = ragged.flatten(texts)
    data, offsets, n = flat.data, flat.offsets, len(texts)
    lead = (data & 0xC0) != 0x80
    words = ragged.words(flat)
    hashes = ragged.span_hashes(data, words.starts, words.ends, ragged.SECRET)
    owners = words.owners()

    lines = ragged.runs(data != 0x0A, offsets)
    solid = np.concatenate(([0], np.cumsum(~ragged.SPACE[data])))
    has_word = solid[lines.ends] > solid[lines.starts]
    line_owner = lines.owners()[has_word]
    line_hash = ragged.span_hashes(data, lines.starts[has_word], lines.ends[has_word], ragged.SECRET)
    dup_lines, _ = _seen_before(line_hash, line_owner)

    windows, at = ragged.window_hashes(hashes, words.first, 3)
    _, twice = _seen_before(windows, np.repeat(np.arange(n), np.diff(at)))
    window_start = np.repeat(words.first[:-1] - at[:-1], np.diff(at)) + np.arange(len(windows))
    repeated = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        repeated[window_start[twice] + k] = True

    known, _ = _seen_before(hashes, owners)
    last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (lead & (data >= 0x80))
    return {
        "n_words": words.counts,
        "word_chars": _per_text(lead & ~ragged.SPACE[data], offsets),
        "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_owner[dup_lines], minlength=n),
        "n_repeat_words": np.bincount(owners[repeated], minlength=n),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_upper": _per_text(upper, offsets),
        "n_letters": _per_text(letters, offsets),
        "n_ends": np.bincount(owners[np.isin(last, list(b".!?"))], minlength=n),
        "n_distinct_words": words.counts - np.bincount(owners[known], minlength=n),
    }


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [count_features(piece) for _, _, piece in ragged.chunks(batch)]
    ragged.release()
    columns = [pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64)) for c in COUNTS]
    return pa.StructArray.from_arrays(columns, names=list(COUNTS))


def _vote(junk: Column, fine: Column) -> Column:
    return F.when(junk, F.lit(-1)).when(fine, F.lit(1)).otherwise(F.lit(0))


def votes(c) -> dict[str, Column]:
    """One column per rule; ``c`` gives the column of a count by its name. No words: every rule abstains but length."""
    words = c("n_words")
    some = words > 0
    rules = {
        "length": _vote(words < MIN_WORDS, words >= 2 * MIN_WORDS),
        "symbols": _vote(some & (10 * c("n_symbols") > words), some & (50 * c("n_symbols") <= words)),
        "symbol_mass": _vote(some & (40 * c("n_symbols") > c("word_chars")), some & (200 * c("n_symbols") <= c("word_chars"))),
        "repeats": _vote(some & (4 * c("n_repeat_words") > words), some & (20 * c("n_repeat_words") <= words)),
        "lines": _vote(4 * c("n_dup_lines") > c("n_lines"), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        "shouting": _vote(some & (2 * c("n_upper") > c("n_letters")), some & (8 * c("n_upper") <= c("n_letters"))),
        "sentences": _vote(some & (40 * c("n_ends") < words), some & (20 * c("n_ends") >= words)),
        "word_length": _vote(
            some & ((c("word_chars") < 2 * words) | (c("word_chars") > 15 * words)),
            some & c("word_chars").between(3 * words, 10 * words),
        ),
        "vocabulary": _vote(
            some & (words >= MIN_WORDS) & (5 * c("n_distinct_words") < words), some & (3 * c("n_distinct_words") >= words)
        ),
    }
    return rules


@dataclass(frozen=True)
class VoteModel:
    """``prior``: share of fine documents; ``chance[rule][vote]``: (given junk, given fine)."""

    prior: float
    chance: dict[str, dict[int, tuple[float, float]]]

    def posterior(self, rules: dict[str, Column]) -> Column:
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, column in rules.items():
            weight = {v: math.log(fine / junk) for v, (junk, fine) in self.chance[name].items()}
            logit = logit + F.when(column < 0, weight[-1]).when(column > 0, weight[1]).otherwise(weight[0])
        return 1 / (1 + F.exp(-logit))


def fit(patterns: np.ndarray, counts: np.ndarray, names: Sequence[str], rounds: int = 500, tolerance: float = 1e-9) -> VoteModel:
    """EM over vote patterns (rows of -1, 0, 1) and how many documents have each.

    A Dirichlet prior worth 2 % of the documents says what a rule is written for: it
    calls junk junk more often than it calls fine junk. That fixes which of the two
    classes is the fine one.
    """
    start = {-1: (0.40, 0.01), 0: (0.30, 0.19), 1: (0.30, 0.80)}
    strength = 1 + 0.02 * float(counts.sum())
    prior = 0.9
    chance = np.array([[start[v] for v in (-1, 0, 1)] for _ in names])  # rule, vote, class
    belief = np.array([strength * chance[j] for j in range(len(names))])
    index = patterns + 1
    for _ in range(rounds):
        score = np.log([1 - prior, prior]) + sum(np.log(chance[j][index[:, j]]) for j in range(len(names)))
        score -= score.max(axis=1, keepdims=True)
        share = np.exp(score)
        share /= share.sum(axis=1, keepdims=True)
        mass = share * counts[:, None]
        fresh = belief.copy()
        for j in range(len(names)):
            for v in range(3):
                fresh[j, v] += mass[index[:, j] == v].sum(axis=0)
        fresh /= fresh.sum(axis=1, keepdims=True)
        moved = np.abs(fresh - chance).max()
        prior = float((mass[:, 1].sum() + 8) / (counts.sum() + 10))
        chance = fresh
        if moved < tolerance:
            break
    table = {n: {v: (float(chance[j, v + 1, 0]), float(chance[j, v + 1, 1])) for v in (-1, 0, 1)} for j, n in enumerate(names)}
    return VoteModel(prior, table)


def fit_votes(voted: DataFrame, names: Sequence[str]) -> VoteModel:
    """Fit to the documents that passed the base test, which settles the others by itself.

    ``voted`` has one vote column per rule; only pattern counts reach the driver.
    """
    rows = voted.filter(~F.col("failed")).groupBy(*names).agg(F.count(F.lit(1)).alias("n_docs")).collect()
    rows = sorted(rows, key=lambda r: [r[n] for n in names])
    patterns = np.array([[r[n] for n in names] for r in rows], dtype=int).reshape(-1, len(names))
    return fit(patterns, np.array([r["n_docs"] for r in rows], dtype=float), names)


def base_failed(c) -> Column:
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > REPEAT_SHARE * c("n_words"))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept, one row per document."""
    counted = docs.select("doc_id", text_counts("text").alias("c")).select("doc_id", "c.*")
    rules = votes(F.col)
    counted = settle(counted.select("*", *[v.cast("byte").alias(f"vote_{n}") for n, v in rules.items()]), "quality")
    ballots = {n: F.col(f"vote_{n}") for n in rules}
    failed = base_failed(F.col)
    model = fit_votes(counted.select(failed.alias("failed"), *[v.alias(n) for n, v in ballots.items()]), list(rules))
    quality = model.posterior(ballots)
    return counted.select(
        "doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality")
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with all their columns and no shuffle: the counts are made
    once for the fit and once more beside each text for the decision."""
    rules = votes(F.col)
    voted = docs.select(text_counts("text").alias("c")).select("c.*")
    voted = voted.select(base_failed(F.col).alias("failed"), *[v.alias(n) for n, v in rules.items()])
    model = fit_votes(voted, list(rules))
    held = "_counts"
    while held in docs.columns:
        held += "_"
    inner = lambda name: F.col(f"{held}.{name}")
    passed = ~base_failed(inner) & (model.posterior(votes(inner)) >= threshold)
    return docs.withColumn(held, text_counts("text")).filter(passed).drop(held)
