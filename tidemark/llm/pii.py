"""Personal data: fixed patterns, and terms that reveal whose data it is.

The patterns give e-mail addresses, IP addresses, card and telephone numbers. Their
values are the protected entities. A term (a run of letters) that keeps appearing near
one entity and hardly elsewhere identifies it, as a name does, even when the number is
gone. How strongly is estimated from the whole corpus, in two ways:

* by documents: of the n(t) documents with the term, n(t, e) have it within ``reach``
  terms of the entity, so it names the entity with probability n(t, e) / n(t), against
  n(e) / n of all documents;
* by places: of all places where the term stands, those near the entity, against the
  share of all terms that stand near it. This also tells the names of an entity that is
  in most documents, or in one document many times.

The evidence is n(t, e) times the bits log2 of probability over chance: many documents
make up for an entity that is frequent by itself. Terms beyond the thresholds either way
are generalised wherever they stand. Documents of equal text count once. By places,
contexts (the term with its two neighbours outside all spans) count as well as documents.

Terms near entities are few; only their hashes go back to the scans that count and mark
them, ``HASHES`` at a time however many there are. Defined cases: a NULL or empty text
has no spans; repeated rows get equal results; overlapping spans are cut out as one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import ragged
from tidemark.session import settle

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[NAME]"}
# The patterns, in forms that never scan a run of characters twice.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HASHES = 1_000_000
REACH = 6
TERM_BYTES = 3
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the characters allowed before its @ start, so only the @ are looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1  # no address goes over an @ before its own
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def suspects(flat: ragged.Flat) -> np.ndarray:
    """Rows with a digit or an @; no pattern fits any other."""
    marked = ((flat.data >= 48) & (flat.data <= 57)) | (flat.data == 64)
    return np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(marked)))[flat.offsets]))


def terms(flat: ragged.Flat) -> tuple[ragged.Spans, np.ndarray]:
    """Runs of letters and their hashes (A-Z as a-z)."""
    spans = ragged.runs(LETTERS[flat.data], flat.offsets)
    return spans, ragged.span_hashes(ragged.UPPER_TO_LOWER[flat.data], spans.starts, spans.ends)


def contexts_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the terms of one text with both their neighbours."""
    before, after = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:], after[:-1] = hashes[:-1], hashes[1:]
    return ragged.mix(hashes + ragged.mix(before) * np.uint64(3) + ragged.mix(after) * np.uint64(7))


def text_hashes(flat: ragged.Flat) -> np.ndarray:
    """A hash of each whole text; 0 for an empty one."""
    out, held = np.zeros(len(flat.offsets) - 1, dtype=np.uint64), np.diff(flat.offsets) > 0
    out[held] = ragged.span_hashes(flat.data, flat.offsets[:-1][held], flat.offsets[1:][held])
    return out


def byte_bounds(data: np.ndarray, found: list[tuple[str, int, int]]) -> np.ndarray:
    """[start, end) of spans in the bytes of their text."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[[x[1:] for x in found]]


def tally(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one row for each distinct combination of keys, and how often it occurs."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(fresh)
    return order[first], np.diff(np.append(first, len(order)))


def entity_hash(kind: str, value: str) -> int:
    """Equal for equal values: without case, spaces and punctuation where they carry nothing."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else re.sub(r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def neighbours(docs: DataFrame, reach: int) -> DataFrame:
    """(entity, term, context, doc, n): the terms within ``reach`` terms of an entity, outside all spans, and how often.

    doc is a hash of the text. Rows without an entity carry the number of terms of a text.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("entity", "term", "context", "doc", "n")])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in ragged.chunks(batch):
                flat = ragged.flatten(texts)
                docs_ = text_hashes(flat).view(np.int64)
                n_terms = ragged.runs(LETTERS[flat.data], flat.offsets).counts
                none = pa.nulls(len(docs_), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n_terms, pa.int64()), none, pa.array(docs_), none], names=schema.names)
                out: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
                for row in suspects(flat).tolist():
                    text = texts[row].as_py()
                    found = base_spans(text)
                    if not found:
                        continue
                    own = ragged.Flat(flat.data[flat.offsets[row] : flat.offsets[row + 1]], np.array([0, flat.offsets[row + 1] - flat.offsets[row]]))
                    spans, hashes = terms(own)
                    bounds = byte_bounds(own.data, found)
                    free = np.ones(len(hashes), dtype=bool)
                    for s, e in bounds:
                        free[np.searchsorted(spans.ends, s, "right") : np.searchsorted(spans.starts, e, "left")] = False
                    contexts = np.zeros_like(hashes)
                    contexts[free] = contexts_of(hashes[free])
                    free &= spans.ends - spans.starts >= TERM_BYTES
                    places: dict[int, list[np.ndarray]] = {}
                    for (kind, s, e), (low, high) in zip(found, bounds):
                        first, last = np.searchsorted(spans.ends, low, "right"), np.searchsorted(spans.starts, high, "left")
                        near = np.arange(max(0, first - reach), min(len(hashes), last + reach))
                        places.setdefault(entity_hash(kind, text[s:e]), []).append(near[free[near]])
                    for entity, near in places.items():
                        near = np.unique(np.concatenate(near))  # a place between two mentions counts once
                        at, n = tally(contexts[near], hashes[near])
                        out.append((entity, docs_[row], hashes[near[at]], contexts[near[at]], n))
                if out:
                    sizes = [len(x[4]) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.array([x[0] for x in out], dtype=np.int64), sizes)),
                            pa.array(np.concatenate([x[2] for x in out]).view(np.int64)),
                            pa.array(np.concatenate([x[3] for x in out]).view(np.int64)),
                            pa.array(np.repeat(np.array([x[1] for x in out], dtype=np.int64), sizes)),
                            pa.array(np.concatenate([x[4] for x in out]), pa.int64()),
                        ],
                        names=schema.names,
                    )

    return docs.select("text").mapInArrow(compute, schema)


def hash_parts(rows: DataFrame, column: str) -> Iterator[np.ndarray]:
    """All values of a hash column as sorted arrays of at most HASHES values or so, by ranges of the hash."""
    n = rows.count()
    parts = max(1, -(-2 * n // HASHES))
    for k in range(parts):
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == k)
        yield np.sort(np.array([r[0] for r in part.select(column).collect()], dtype=np.int64).view(np.uint64))


def _member(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return wanted[at] == hashes


def occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, doc, n) wherever one of the terms stands outside all spans: an address may hold the name as well."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("term", "doc", "n")])
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in ragged.chunks(batch):
                flat = ragged.flatten(texts)
                spans, hashes = terms(flat)
                hit = _member(held.value, hashes)
                for row in suspects(flat).tolist():
                    (low, high), (begin, end) = spans.first[row : row + 2], flat.offsets[row : row + 2]
                    if hit[low:high].any() and (fixed := base_spans(texts[row].as_py())):
                        for s, e in byte_bounds(flat.data[begin:end], fixed) + begin:
                            hit[low + np.searchsorted(spans.ends[low:high], s, "right") : low + np.searchsorted(spans.starts[low:high], e, "left")] = False
                found, rows = hashes[hit], spans.owners()[hit]
                at, n = tally(found, rows)
                columns = [found[at].view(np.int64), text_hashes(flat)[rows[at]].view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.names)

    return docs.select("text").mapInArrow(compute, schema)


def revealing_terms(docs: DataFrame, reach: int = REACH, support: int = 4, share: float = 0.7, bits: float = 6.0) -> DataFrame:
    """(term, entity, bits, share) of the terms beyond the thresholds; written once.

    ``support``: documents (by places, also contexts) a term must share with the entity at
    least. ``bits``: what each of so few must tell; of more, together as much.
    """
    # copies of a text have equal rows, so the largest n is that of one copy
    rows = settle(neighbours(docs, reach).groupBy("entity", "term", "context", "doc").agg(F.max("n").alias("n")), "neighbours")
    near = rows.filter(F.col("entity").isNotNull())
    together = near.groupBy("entity", "term").agg(
        F.count_distinct("doc").alias("docs_te"), F.count_distinct("context").alias("contexts_te"), F.sum("n").alias("stands_te")
    )
    entity = near.groupBy("entity").agg(F.count_distinct("doc").alias("docs_e"), F.sum("n").alias("stands_e"))
    n_docs, n_terms = rows.filter(F.col("entity").isNull()).agg(F.count(F.lit(1)), F.sum("term")).first()
    enough = F.greatest("docs_te", "contexts_te")

    def told(n: Column, by: str, total: int) -> Column:
        """(bits, share) of the pairs beyond the thresholds, else NULL."""
        part = F.col(f"{by}_te") / F.col(f"{by}_t")
        gain = F.log2(part * F.lit(float(total)) / F.col(f"{by}_e"))
        return F.when((n >= support) & (part >= share) & (n * gain >= support * bits), F.struct(gain.alias("bits"), part.alias("share")))

    found = F.coalesce(told(F.col("docs_te"), "docs", n_docs), told(enough, "stands", n_terms or 0))
    # a term stands at least where it is near any entity: what fails by these counts is not looked for
    least = near.groupBy("term", "context", "doc").agg(F.max("n").alias("n"))
    least = least.groupBy("term").agg(F.count_distinct("doc").alias("docs_t"), F.sum("n").alias("stands_t"))
    pairs = together.filter(enough >= support).join(entity, "entity").join(least, "term").filter(found.isNotNull())
    pairs = settle(pairs.drop("docs_t", "stands_t"), "pairs")
    counted = None
    candidates = pairs.select("term").distinct()
    for wanted in hash_parts(candidates, "term"):
        if not len(wanted):
            break
        part = occurrences(docs, wanted).groupBy("term", "doc").agg(F.max("n").alias("n"))
        part = part.groupBy("term").agg(F.count(F.lit(1)).alias("docs_t"), F.sum("n").alias("stands_t"))
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return pairs.select("term", "entity", F.lit(0.0).alias("bits"), F.lit(0.0).alias("share"))
    named = pairs.join(counted, "term").select("term", "entity", found.alias("found")).filter(F.col("found").isNotNull())
    return settle(named.select("term", "entity", "found.bits", "found.share"), "revealing")


def term_spans(texts: pa.Array, wanted: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Spans of the wanted terms by row, in code points."""
    if not len(wanted):
        return {}
    flat = ragged.flatten(texts)
    spans, hashes = terms(flat)
    hit = np.flatnonzero(_member(wanted, hashes))
    if not len(hit):
        return {}
    points = np.concatenate(([0], np.cumsum((flat.data & 0xC0) != 0x80)))
    rows = np.searchsorted(spans.first, hit, "right") - 1
    origin = points[flat.offsets[rows]]
    out: dict[int, list[tuple[str, int, int]]] = {}
    for row, s, e in zip(rows.tolist(), (points[spans.starts[hit]] - origin).tolist(), (points[spans.ends[hit]] - origin).tolist()):
        out.setdefault(row, []).append(("term", s, e))
    return out


def outside(found: list[tuple[str, int, int]], fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The found spans that overlap none of the fixed ones, by start; ``fixed`` is sorted by start."""
    starts, ends = [], []
    for _, s, e in fixed:  # as spans apart from each other
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    starts.append(1 << 62)
    return sorted((x for x in found if starts[bisect_right(ends, x[1])] >= x[2]), key=lambda x: x[1])


def find_all(texts: pa.Array, parts: list[np.ndarray]) -> Iterator[tuple[int, list, list]]:
    """(row, base spans, term spans outside them) of the rows that have any."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for first, _, piece in ragged.chunks(batch):
        base = {row: base_spans(piece[row].as_py()) for row in suspects(ragged.flatten(piece)).tolist()}
        named: dict[int, list] = {}
        for wanted in parts:
            for row, found in term_spans(piece, wanted).items():
                named.setdefault(row, []).extend(found)
        for row in sorted(base.keys() | named.keys()):
            fixed = base.get(row, [])
            extra = outside(named.get(row, []), fixed)
            if fixed or extra:
                yield first + row, fixed, extra


REPORT = T.StructType(
    [*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def reporter(parts: list[np.ndarray]):
    """A column function: counts per kind, hash of the base spans, all spans."""

    @F.arrow_udf(REPORT)
    def report(texts: pa.Array) -> pa.Array:
        nothing = hashlib.sha256(b"").hexdigest()
        counts = np.zeros((len(KINDS), len(texts)), dtype=np.int64)
        digests, spans = [nothing] * len(texts), [""] * len(texts)
        for row, fixed, extra in find_all(texts, parts):
            for kind, _, _ in fixed:
                counts[KINDS.index(kind), row] += 1
            digests[row] = hashlib.sha256(_joined(fixed).encode()).hexdigest()
            spans[row] = _joined(sorted(fixed + extra, key=lambda x: (x[1], [*KINDS, "term"].index(x[0]))))
        ragged.release()
        columns = [*[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(columns, names=REPORT.names)

    return report


def scrubber(parts: list[np.ndarray]):
    """A column function: the text with each span, or run of overlapping spans, replaced by its kind."""

    @F.arrow_udf(T.StringType())
    def scrub(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for row, fixed, extra in find_all(texts, parts):
            text, done, pieces = out[row], 0, []
            for kind, s, e in sorted(fixed + extra, key=lambda x: (x[1], x[2])):
                if s >= done:
                    pieces += [text[done:s], MASKS[kind]]
                done = max(done, e)
            out[row] = "".join(pieces) + text[done:]
        ragged.release()
        return pa.array(out, pa.string())

    return scrub


def _parts(docs: DataFrame, **thresholds) -> list[np.ndarray]:
    return [p for p in hash_parts(revealing_terms(docs, **thresholds).select("term").distinct(), "term") if len(p)]


def report(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    found = reporter(_parts(docs, **thresholds))(F.col("text"))
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.*")


def scrub_documents(docs: DataFrame, **thresholds) -> DataFrame:
    """All documents with their spans replaced; an n_chars column, if there is one, is set to the new length."""
    clean: Column = scrubber(_parts(docs, **thresholds))(F.col("text"))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
