"""Spelling variants: a relational trie frontier finds all words one edit away.

The words of the corpus form a trie whose edges are a distributed table (node, label,
child). Chains without a branch or a word's end are one edge, so a node is a place where words
part or end. Two words one edit apart part at such a node: the frontier starts with
the states (word, position, node, 0 edits) of each word at the nodes on its own path,
spends the edit at an edge that leaves the path (replace, insert or delete) and
then joins the edge table level by level, the label against the word's next letters, until
no state is left. A state that has used up its word is a neighbour if its node ends a word.

A word with its edit in the first half is equal to the other in the second, so the same
is done with the words written backwards, and on either side a state starts at half of
its word at least: there the trie is thin, and no node is shared by so many words as
the first letters are. A node has at most as many edges as there are letters.

Nodes are 64-bit hashes of prefixes. Equal hashes of different prefixes could only add
states, and every pair found is compared letter by letter.

Defined cases: a NULL or empty text has no words; a NULL doc_id counts as empty in the
hash; repeated rows count again; words of any length take part, at one join per branching on
the way; ties in n go to the smaller word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import settle

# The letters of a word, the letters lowered, and how often a letter is left out.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 31


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word and n (occurrences); of one run in ``DELETE_EVERY``, chosen by its hash, one letter is left out first.

    A run never gets longer, so shorter ones are not taken out of the text at all.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    hashed = found.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = hashed.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _size(word: str = "word") -> Column:
    return F.char_length(word)


def _part(text: str, start: Column | int, length: Column | int) -> Column:
    """``length`` letters from position ``start`` (from 0) on."""
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.substring(text, start + 1, length)


def _node(depth: Column) -> Column:
    return F.xxhash64("side", _part("word", 0, depth))


def trie(sided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes on each word's path: side, word, stops; edges: node, label, child, ahead) of words with a side.

    Of a path only the part that a word of a length one more or less can reach is built.
    ``ahead`` has a bit for every letter (modulo 64) that goes on from the child, and
    for the end of a word: a state that finds no way on is not even made.
    """
    low = F.greatest(F.lit(0), F.floor((_size() - 1 + F.col("side")) / 2).cast("int"))
    places = sided.select("side", "word", F.explode(F.sequence(low, _size())).alias("d"))
    letter = F.ascii(_part("word", F.col("d"), 1))  # 0 where the word ends
    nodes = places.select(_node(F.col("d")).alias("node"), letter.alias("letter"))
    spread = nodes.groupBy("node").agg(F.min("letter").alias("low"), F.max("letter").alias("high"))
    stops = spread.filter("low = 0 OR low < high").select("node")
    inner = places.filter(F.col("d") < _size()).withColumn("node", _node(F.col("d")))
    met = inner.join(stops, "node", "left_semi").select("side", "word", "d")
    ends = sided.select("side", "word", _size().alias("d"))
    paths = met.unionByName(ends).groupBy("side", "word").agg(F.array_sort(F.collect_list("d")).alias("stops"))
    paths = settle(paths, "paths")
    steps = paths.select("side", "word", F.posexplode("stops").alias("i", "d"), "stops").withColumn("to", F.try_element_at("stops", F.col("i") + 2))
    steps = steps.filter("to IS NOT NULL")
    labelled = steps.select(_node(F.col("d")).alias("node"), _part("word", F.col("d"), F.col("to") - F.col("d")).alias("label"), _node(F.col("to")).alias("child"))
    edges = settle(labelled.distinct(), "edges")
    letters = edges.select("node", F.ascii(_part("label", 0, 1)).alias("letter"))
    letters = letters.unionByName(sided.select(_node(_size()).alias("node"), F.lit(0).alias("letter")))
    ahead = letters.groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit(F.col("letter"))).alias("ahead"))
    return paths, settle(edges.join(ahead, "child"), "edges")


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), letter.bitwiseAND(63))


def _goes_on(position: Column) -> Column:
    """Does the child lead on by the word's letter at the position, or end where the word does?"""
    return F.col("ahead").bitwiseAND(_bit(F.ascii(_part("word", position, 1)))) != 0


def _first_edits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """States after the edit: side, word, position, node."""
    start = F.floor((_size() + F.col("side")) / 2).cast("int")
    own = paths.select("side", "word", F.explode("stops").alias("d")).filter(F.col("d") >= start).withColumn("node", _node(F.col("d")))
    last = own.filter(F.col("d") == _size() - 1).select("side", "word", _size().alias("position"), "node")  # its last letter deleted
    leaving = own.join(edges, "node").filter(_part("label", 0, 1) != _part("word", F.col("d"), 1))
    d, k, n = F.col("d"), F.char_length("label"), _size()
    tail = F.substring("label", F.lit(2), k)
    replaced = F.when((d + k <= n) & _goes_on(d + k) & (_part("word", d + 1, k - 1) == tail), d + k)
    inserted = F.when((d + k - 1 <= n) & _goes_on(d + k - 1) & (_part("word", d, k - 1) == tail), d + k - 1)
    deleted = F.when((d + 1 + k <= n) & _goes_on(d + 1 + k) & (_part("word", d + 1, k) == F.col("label")), d + 1 + k)
    leaving = leaving.filter(replaced.isNotNull() | inserted.isNotNull() | deleted.isNotNull())
    moved = leaving.select("side", "word", F.explode(F.array_compact(F.array(replaced, inserted, deleted))).alias("position"), F.col("child").alias("node"))
    return moved.unionByName(last)


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs of words one edit apart: word, n, near, near_n. ``words`` (word, n) should be a written table."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))
    sided = words.select("n", F.inline(sides)).select("side", "word", "n")
    paths, edges = trie(sided.drop("n"))
    states = settle(_first_edits(paths, edges), "states")
    ended = [states.filter(F.col("position") == _size())]
    while True:
        met = states.filter(F.col("position") < _size()).join(edges, "node")
        fits = (F.col("position") + F.char_length("label") <= _size()) & (_part("word", F.col("position"), F.char_length("label")) == F.col("label"))
        after = F.col("position") + F.char_length("label")
        states = met.filter(fits & _goes_on(after)).select("side", "word", after.alias("position"), F.col("child").alias("node"))
        states = settle(states, "states")
        if states.isEmpty():
            break
        ended.append(states.filter(F.col("position") == _size()))
    done = ended[0]
    for level in ended[1:]:
        done = done.unionByName(level)
    ends = sided.select(F.col("side").alias("_side"), F.col("word").alias("near"), F.col("n").alias("near_n"), _node(_size()).alias("node"))
    pairs = done.join(ends, "node").filter((F.col("side") == F.col("_side")) & (F.levenshtein("word", "near", 1) == 1))
    forward = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("word", "near")]
    pairs = pairs.select("side", *forward, "near_n")
    half = F.floor(_size() / 2).cast("int")
    return pairs.filter((F.col("side") == 0) | (_part("word", 0, half) != _part("near", 0, half))).select("word", "near", "near_n")


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``links`` (word, form), which have no cycles."""
    step = settle(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        jumped = settle(jumped, "forms")
        step = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return step


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """Every word with its form: word, form, root, n, n_near, form_n.

    The form is the near word with the largest n, if that is ``times`` the word's own; the root is the last of the chain of forms.
    """
    words = settle(vocabulary(docs, least_length, least_count), "words")
    top = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"))).alias("top")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), top)
    joined = words.join(near, "word", "left")
    strong = -F.col("top.minus_n") >= times * F.col("n")
    rows = joined.select(
        "word", F.when(strong, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("top.minus_n")).alias("form_n"),
    )
    rows = settle(rows, "variants")
    roots = follow(rows.filter("form IS NOT NULL"))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
