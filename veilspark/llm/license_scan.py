"""Licence notices by a positional index of rare words.

Templates are short notices. Word frequencies over the whole corpus say which words of a
template are rare; the rarer half (by inverse document frequency) is indexed as word ->
(template, position). A file looks up its own rare licence words, and every occurrence votes
for a template at one start (its place minus the position), so postings intersect by relative
position. Starts with enough votes are checked: all mandatory key phrases must stand at their
places, word by word.

Base phrases are templates whose key phrase is the whole template, so a start that holds one
has all votes and is never missed.

Cases. Null or empty text: no words, nothing found, score 0. Repeated rows are judged alike.
Overlapping places all count. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, take_columns, texts

# Phrases of the base rule and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Further notices; what stands in brackets is mandatory, word by word.
NOTICES = (
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software"),
    ("apache-2", "[licensed under the apache license version 2] 0 the license you may not use this file "
                 "except in compliance with the license"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee"),
    ("gpl-2", "[gnu general public license version 2]"),
    ("gpl-3", "[gnu general public license version 3]"),
    ("lgpl-2.1", "[gnu lesser general public license version 2 1]"),
    ("lgpl-3", "[gnu lesser general public license version 3]"),
    ("agpl-3", "[gnu affero general public license version 3]"),
    ("mpl-2", "[subject to the terms of the mozilla public license] v 2 0"),
    ("mpl-2", "[mozilla public license version 2]"),
    ("epl-2", "[eclipse public license version 2]"),
    ("cc-by", "[licensed under a creative commons attribution] 4 0 international license"),
    ("cc-by-sa", "[creative commons attribution sharealike]"),
    ("cc0", "[creative commons zero]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
)

MIN_VOTES = 0.6  # share of a template's indexed weight that must stand in place

# Words: everything but ASCII punctuation, spaces and controls.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased."""
    return text.encode().lower().translate(_WORDS).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[tuple[int, int]]  # mandatory phrases: from, to
    base: bool


def parse(label: str, notice: str, base: bool) -> Template:
    words, keys, opened = [], [], 0
    for token in notice.split():
        if token.startswith("["):
            opened = len(words)
        words.append(token.strip("[]").encode())
        if token.endswith("]"):
            keys.append((opened, len(words)))
    return Template(label, words, keys or [(0, len(words))], base)


TEMPLATES = [parse(a, b, True) for a, b in BASE] + [parse(a, b, False) for a, b in NOTICES]


class Index:
    """Postings of the rare words of all templates, with weights from the corpus."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], total: int):
        self.templates = templates
        # + 1 keeps the weight of a word that is in every file above 0
        self.weight = {
            w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1
            for t in templates for w in t.words
        }
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed, self.whole = [], []
        for number, t in enumerate(templates):
            ranked = sorted(set(t.words), key=lambda w: (-self.weight[w], w))
            rare = set(ranked[: (len(ranked) + 1) // 2])
            for at, word in enumerate(t.words):
                if word in rare:
                    self.postings[word].append((number, at))
            self.needed.append(MIN_VOTES * sum(self.weight[w] for w in t.words if w in rare))
            self.whole.append(sum(self.weight[w] for w in t.words))
        self.rare = frozenset(self.postings)

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(start, template, score) of every confirmed notice."""
        if self.rare.isdisjoint(words):
            return []
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for at, word in enumerate(words):
            if word in self.rare:
                weight = self.weight[word]
                for number, position in self.postings[word]:
                    if at >= position:
                        votes[at - position, number] += weight
        found = []
        for (start, number), got in votes.items():
            t = self.templates[number]
            if got < self.needed[number] - 1e-9:
                continue
            if all(words[start + a : start + b] == t.words[a:b] for a, b in t.keys):
                here = words[start : start + len(t.words)]
                inside = sum(self.weight[w] for w, x in zip(t.words, here) if w == x)
                found.append((start, number, inside / self.whole[number]))
        return sorted(found)


def document_counts(rows: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many files each template word occurs, and the number of files. What reaches the
    driver is one number per word of the templates."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[bytes, int] = defaultdict(int)
        for text in texts(batch):
            for word in vocabulary.intersection(words_of(text)):
                counts[word] += 1
        counts[b""] = batch.num_rows  # no word is empty
        return pa.record_batch(
            [pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"])

    found = map_batches(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word.encode(): r.n for r in found.collect()}
    return counts, counts.pop(b"", 0)


_SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, places array<struct<start:bigint,label:string,score:double>>"
)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: list[Template] | None = None,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and all
    confirmed places of every row; score is the largest share of a notice's weight in place."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)
    templates = templates or TEMPLATES
    vocabulary = frozenset(w for t in templates for w in t.words)
    index = Index(templates, *document_counts(rows.select("text"), vocabulary))

    def one(text: str) -> dict:
        words = words_of(text)
        found = index.find(words)
        base = [start for start, number, _ in found if templates[number].base]
        return {
            "n_words": len(words), "n_base": len(base),
            "first_word": min(base, default=None), "last_word": max(base, default=None),
            "base_labels": ",".join(sorted({templates[t].label for _, t, _ in found if templates[t].base})),
            "labels": ",".join(sorted({templates[t].label for _, t, _ in found})),
            "score": min(1.0, max((s for *_, s in found), default=0.0)),
            "places": [{"start": a, "label": templates[t].label, "score": s} for a, t, s in found],
        }

    place = pa.struct([("start", pa.int64()), ("label", pa.string()), ("score", pa.float64())])
    shape = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
        ("score", pa.float64()), ("places", pa.list_(place))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.Table.from_pylist([one(t) for t in texts(batch)], schema=shape).to_batches()[0]
        return pa.record_batch([column(batch, "doc_id"), *table.columns], ["doc_id", *shape.names])

    return map_batches(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, {_SCHEMA}")
