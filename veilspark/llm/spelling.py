"""Spelling variants: words one edit apart, found by a frontier that walks a trie in tables.

The vocabulary is a trie in one table: a row per node (a prefix, by its hash) with its children.
A state of the search is (word, position, node, edits). Words that begin alike share their states
as long as they do, so `word` and `position` are one column, the node `a` of the prefix read so
far; `b` is the node that the search has reached. States without an edit are the nodes themselves
(a = b) and need no row. Level by level

1. each node makes the states with one edit: two of its children (a replaced code point), or the
   node and one of its children (an inserted one, seen from the longer word: a deleted one);
2. each state with its edit done is joined with the children of `a` and then of `b`: it goes on
   with every code point that both have;
3. states whose two nodes both end a word are neighbours.

Every state is made once: of two children the smaller is `a`, and an inserted code point counts
where the run of equal ones begins. A node has at most as many children as the alphabet has code
points, and at most 2 * depth * alphabet states refer to it, so no key is hot, whatever beginning
the words share. Each level is written, so a lost executor costs one level. Hashes only steer the
search: neighbours are confirmed on the words themselves.

One level is one job, so words of `LONG` code points or more do not walk: they are keyed by what is
left after each single deletion (at most the alphabet's number of words share such a key), and
confirmed likewise. No word is left out.

Cases. Null or empty text, or no run: no words. A null id reads as no text before the colon. Runs
of any length count; of a text only a bounded number of runs is held at once. Rows that repeat an
id count again. Equal counts: the smallest word in code-point order is the form. Empty table:
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, stage, take_columns

SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
CLEAR = 10  # times as often as the word: then a neighbour is its form
DROPPED = 31  # one run in so many loses a code point
LONG = 64
# Words counted in a task before they are sent on, by number and by code points.
HELD, HELD_CHARS = 200_000, 8_000_000
WHOLE_TEXT = 1 << 20  # code points; longer texts are read run by run
KEYS = 10_000  # deletion keys per batch
PRIME, BASE = (1 << 61) - 1, 1_000_003


# -- vocabulary -------------------------------------------------------------------

def _runs(text: str, shortest: int) -> Iterator[Counter]:
    """Maximal runs of at least `shortest` letters, lower-cased (A-Z only), counted."""
    found = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")
    text = text.encode().lower().decode()  # of bytes, only A-Z change
    if len(text) <= WHOLE_TEXT:
        yield Counter(found.findall(text))
        return
    runs = (m.group() for m in found.finditer(text))
    while part := Counter(islice(runs, HELD // 8)):
        yield part


def _counter(shortest: int, dropped: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text")):
                start = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for runs in _runs(text.as_py() or "", shortest):
                    for word, n in runs.items():
                        h = zlib.crc32(word.encode(), start)
                        if dropped and h % dropped == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < shortest:
                                continue
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                    if len(held) > HELD or chars > HELD_CHARS:
                        yield out()
                        held, chars = Counter(), 0
        if held:
            yield out()

    return run


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = SHORTEST, least: int = LEAST, dropped: int = DROPPED,
) -> DataFrame:
    """(word, n): the words of at least `shortest` code points that occur at least `least`
    times. `dropped` = 0 leaves every run as it is."""
    given = take_columns(docs, doc_id=id_col, text=text_col)
    given = given.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    counted = map_arrow(given, _counter(shortest, dropped), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- trie ---------------------------------------------------------------------------

def trie(words: DataFrame) -> DataFrame:
    """(depth, node, last, is_word, kids) with kids as (ch, child, ends), at most one for each
    code point of the alphabet. Nodes without kids are left out."""
    n = F.length("word")
    at = words.select("word", F.explode(F.sequence(F.lit(0), n)).alias("depth"))

    def prefix(length):
        return F.xxhash64(F.expr(f"substring(word, 1, {length})"))

    ch = F.when(F.col("depth") < n, F.expr("substring(word, depth + 1, 1)"))
    steps = at.select(
        "depth", prefix("depth").alias("node"), ch.alias("ch"),
        F.when(F.col("depth") > 0, F.expr("substring(word, depth, 1)")).alias("last"),
        F.when(ch.isNotNull(), F.struct(ch.alias("ch"), prefix("depth + 1").alias("child"))).alias("kid"),
        F.when(F.col("depth") + 1 == n, ch).alias("end"), (F.col("depth") == n).alias("whole"),
    )
    nodes = steps.groupBy("depth", "node").agg(
        F.max("last").alias("last"), F.max("whole").alias("is_word"),
        F.collect_set("kid").alias("kids"), F.collect_set("end").alias("ends"),
    ).where(F.size("kids") > 0)
    kids = F.transform(F.sort_array("kids"), lambda k: F.struct(
        k["ch"].alias("ch"), k["child"].alias("child"),
        F.array_contains("ends", k["ch"]).alias("ends")))
    return nodes.select("depth", "node", "last", "is_word", kids.alias("kids"))


STATE = ["a", "b", "gap", "near"]


def _replaced(nodes: DataFrame) -> DataFrame:
    """Two children of one node: the words differ in this code point."""
    pairs = F.flatten(F.transform("kids", lambda x, i: F.transform(
        F.slice("kids", i + 2, F.size("kids")), lambda y: F.struct(
            x["child"].alias("a"), y["child"].alias("b"), F.lit(0).alias("gap"),
            (x["ends"] & y["ends"]).alias("near")))))
    return nodes.select(F.inline(pairs)).select(*STATE)


def _inserted(nodes: DataFrame) -> DataFrame:
    """A node and one of its children: the word under the child has one code point more."""
    kids = F.filter("kids", lambda k: F.col("last").isNull() | (k["ch"] != F.col("last")))
    return nodes.select("node", "is_word", F.explode(kids).alias("k")).select(
        F.col("node").alias("a"), F.col("k.child").alias("b"), F.lit(1).alias("gap"),
        (F.col("is_word") & F.col("k.ends")).alias("near"))


def _advanced(states: DataFrame, here: DataFrame, below: DataFrame) -> DataFrame:
    """States one code point further: one that both nodes have a child for."""
    left = here.select(F.col("node").alias("a"), F.col("kids").alias("a_kids"))
    right = here.select(F.lit(0).alias("gap"), F.col("node").alias("b"), F.col("kids").alias("b_kids"))
    right = right.unionByName(
        below.select(F.lit(1).alias("gap"), F.col("node").alias("b"), F.col("kids").alias("b_kids")))
    both = states.select("a", "b", "gap").join(left, "a").join(right, ["gap", "b"])
    step = F.filter(F.transform("a_kids", lambda x: F.struct(
        x.alias("x"), F.get(F.filter("b_kids", lambda y: y["ch"] == x["ch"]), F.lit(0)).alias("y"))),
        lambda s: s["y"].isNotNull())
    return both.select("gap", F.explode(step).alias("s")).select(
        F.col("s.x.child").alias("a"), F.col("s.y.child").alias("b"), "gap",
        (F.col("s.x.ends") & F.col("s.y.ends")).alias("near"))


def _walk(words: DataFrame, longest: int) -> DataFrame:
    """(a, b): the hashes of words that the frontier finds one edit apart."""
    ordered = trie(words).repartition("depth", F.pmod("node", F.lit(64))).sortWithinPartitions("depth")
    nodes = stage(ordered, "trie")  # sorted: a level's rows are read without the others
    found, states = [], None
    for depth in range(longest + 1):
        here, below = nodes.where(F.col("depth") == depth), nodes.where(F.col("depth") == depth + 1)
        inserted = _inserted(here)
        entered = states.unionByName(inserted) if states is not None else inserted
        states = stage(_advanced(entered, here, below).unionByName(_replaced(here)), "frontier")
        found += [inserted, states]
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    return near.where("near").select("a", "b")


# -- long words -----------------------------------------------------------------------

def deletion_keys(word: str) -> Iterator[tuple[int, int]]:
    """(position, hash) of the word without the code point there."""
    codes = [ord(c) + 1 for c in word]
    tail = [0] * (len(codes) + 1)  # hash of what follows, read from the right
    for i in range(len(codes) - 1, -1, -1):
        tail[i] = (tail[i + 1] * BASE + codes[i]) % PRIME
    head, power = 0, 1
    for i, c in enumerate(codes):
        yield i, (head + tail[i + 1] * power) % PRIME
        head = (head + c * power) % PRIME
        power = power * BASE % PRIME


def word_key(word: str) -> int:
    key = 0
    for c in reversed(word):
        key = (key * BASE + ord(c) + 1) % PRIME
    return key


def _long_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "n", "at", "key"]
    for batch in batches:
        for node, word in zip(column(batch, "a"), column(batch, "word")):
            node, word = node.as_py(), word.as_py()
            rows = chain(
                [(node, len(word), -1, word_key(word))],
                ((node, len(word), i, key) for i, key in deletion_keys(word)))
            while part := list(islice(rows, KEYS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names)


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, b) for words of LONG code points or more that share what a deletion leaves."""
    given = words.select(F.xxhash64("word").alias("a"), "word")
    keys = stage(map_arrow(given, _long_keys, "a bigint, n bigint, at bigint, key bigint"), "long-words")
    cut = keys.where("at >= 0")
    other = cut.select(F.col("a").alias("b"), "n", "at", "key")
    replaced = cut.join(other, ["n", "at", "key"]).where("a < b").select("a", "b")
    whole = keys.where("at < 0").select("a", "key", "n")
    longer = cut.select(F.col("a").alias("b"), "key", (F.col("n") - 1).alias("n")).distinct()
    return replaced.unionByName(whole.join(longer, ["key", "n"]).select("a", "b"))


# -- result -----------------------------------------------------------------------------

def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, for all pairs of words exactly one edit apart.
    `words` (word, n) holds each word once and is best a written table."""
    longest = words.agg(F.max(F.length("word"))).first()[0]
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    if longest is None:
        ids = words.select(F.xxhash64("word").alias("a"), F.xxhash64("word").alias("b"))
    else:
        ids = _walk(words.where(F.length("word") <= LONG), min(longest, LONG))
        if longest > LONG:
            ids = ids.unionByName(_long_pairs(words.where(F.length("word") >= LONG)))
    left = named.select(F.col("id").alias("a"), F.col("word").alias("x"), F.col("n").alias("x_n"))
    right = named.select(F.col("id").alias("b"), F.col("word").alias("y"), F.col("n").alias("y_n"))
    pairs = ids.join(left, "a").join(right, "b").where(F.levenshtein("x", "y", 1) == 1)
    # words of LONG code points are looked for both ways, in either order
    one, two = F.struct(F.col("x").alias("w"), F.col("x_n").alias("n")), F.struct(F.col("y").alias("w"), F.col("y_n").alias("n"))
    pairs = pairs.select(F.least(one, two).alias("l"), F.greatest(one, two).alias("g")).select(
        F.col("l.w").alias("x"), F.col("l.n").alias("x_n"), F.col("g.w").alias("y"), F.col("g.n").alias("y_n"))
    pairs = stage(pairs.distinct(), "neighbours")
    back = pairs.select("y", "y_n", "x", "x_n")
    return pairs.union(back).toDF("word", "n", "other", "other_n")


def variants(words: DataFrame, clear: int = CLEAR) -> DataFrame:
    """Each word with its form, the root that its forms lead to, and its number of neighbours:
    word, form, root, n, n_near, form_n."""
    best = F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.down") >= clear * F.col("n")
    near = stage(near.select(
        "word", "n_near", F.when(is_form, F.col("best.form")).alias("form"),
        F.when(is_form, -F.col("best.down")).alias("form_n")), "forms")
    forms = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # every step multiplies n by `clear`, so the longest chain is known; each round doubles its reach
    most = words.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, clear)) + 1 if clear > 1 else most
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        forms = stage(
            forms.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")),
            "roots")
    return (
        words.join(near, "word", "left").join(forms, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`variants` of the words of whole texts."""
    return variants(stage(count_words(docs, id_col, text_col), "words"))
