"""A trained recogniser of people and places: averaged perceptron over token features, decoded by
Viterbi; and places known from a table, joined.

Training mixes parameters: every shard of the rows runs one pass of the perceptron from the common
weights, the shards' averaged weights are averaged, and the next pass begins there. Features are
hashed into a table of fixed size, so a model has the same few megabytes whatever it has seen, and
that is all that travels between driver and tasks. All rows are learnt from; more rows make more shards.

`Tagger` is a `DetectConfig.ner_fn`; `known_places` gives a column for `DetectConfig.ner_col`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recogniser import ENTITIES
from .skew import counted_join, written

TAGS = ["O", "B-PERSON", "I-PERSON", "B-GPE", "I-GPE"]
TAG = {t: k for k, t in enumerate(TAGS)}
FEATURES = 1 << 18
SHARDS = 8
SHARD_ROWS = 2500  # from 8 times as many on, there are more shards
EPOCHS = 5
_TOKEN = re.compile(r"\w+|[^\w\s]|\n")
_SEGMENT = 200  # tokens decoded together


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]


def _shape(word: str) -> str:
    short = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", word)))
    return short[:6]


def _features(words: list[str], i: int) -> list[int]:
    w = words[i]
    low = w.lower()
    before, after = words[i - 1] if i else "^", words[i + 1] if i + 1 < len(words) else "$"
    two = words[i - 2] if i > 1 else "^"
    far = words[i + 2] if i + 2 < len(words) else "$"
    shape, left, right = _shape(w), _shape(before), _shape(after)
    names = (
        "b", f"w={low}", f"s={shape}", f"p={low[:3]}", f"e={low[-3:]}", f"e2={low[-2:]}", f"l={before.lower()}",
        f"r={after.lower()}", f"ls={left}/{shape}", f"rs={shape}/{right}", f"ll={two.lower()}/{before.lower()}",
        f"rr={after.lower()}/{far.lower()}", f"lsr={left}/{shape}/{right}", f"n={min(len(w), 9)}/{shape}",
        f"lw={before.lower()}/{shape}", f"rw={shape}/{after.lower()}")
    return [zlib.crc32(n.encode()) & (FEATURES - 1) for n in names]


def _viterbi(emitted: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags; `moves[-1]` holds the scores of first tags."""
    score, back = emitted[0] + moves[-1], []
    for row in emitted[1:]:
        reached = score[:, None] + moves[:-1]
        back.append(reached.argmax(axis=0))
        score = reached.max(axis=0) + row
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


@dataclass
class Tagger:
    """`tagger(text)` gives (start, end, label), labels PERSON and GPE."""

    weights: np.ndarray  # FEATURES x tags
    moves: np.ndarray  # tags + 1 x tags

    def tags(self, words: list[str]) -> list[int]:
        out = []
        for at in range(0, len(words), _SEGMENT):
            part = words[at : at + _SEGMENT]
            if any(w[:1].isupper() for w in part):
                emitted = np.array([self.weights[_features(part, i)].sum(axis=0) for i in range(len(part))])
                out += _viterbi(emitted, self.moves)
            else:
                out += [TAG["O"]] * len(part)
        return out

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        found = tokens(text)
        spans, tags = [], self.tags([w for *_, w in found])
        for (start, end, _), tag in zip(found, tags):
            kind = TAGS[tag][2:]
            if TAGS[tag].startswith("I-") and spans and spans[-1][2] == kind and spans[-1][3]:
                spans[-1][1] = end
            elif kind:
                spans.append([start, end, kind, True])
                continue
            if not kind and spans:
                spans[-1][3] = False
        return [(s, e, k) for s, e, k, _ in spans]


def _gold(found: list[tuple[int, int, str]], spans: list) -> list[int]:
    out = []
    for start, end, _ in found:
        tag = "O"
        for s in spans:
            if s["start"] <= start and end <= s["end"]:
                tag = ("B-" if start == s["start"] else "I-") + s["label"]
        out.append(TAG[tag])
    return out


def _pass(weights: np.ndarray, moves: np.ndarray):
    """One pass over a shard from the given weights; a row per feature that changed, with the
    average over the pass less what it was."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = weights.copy(), moves.copy()
        # sum of updates times the step at which they came: the average needs no second table of steps
        late_w, late_m, step = {}, np.zeros_like(m), 1
        for batch in batches:
            texts, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "spans"))
            for text, gold_spans in zip(texts, spans):
                found = tokens(text or "")
                words = [x for *_, x in found]
                gold = _gold(found, gold_spans or [])
                for at in range(0, len(words), _SEGMENT):
                    part, right = words[at : at + _SEGMENT], gold[at : at + _SEGMENT]
                    feats = [_features(part, i) for i in range(len(part))]
                    guess = _viterbi(np.array([w[f].sum(axis=0) for f in feats]), m)
                    step += 1
                    last_g = last_r = len(TAGS)
                    for f, g, r in zip(feats, guess, right):
                        if g != r:
                            for k in f:
                                w[k, r] += 1
                                w[k, g] -= 1
                                late = late_w.setdefault(k, np.zeros(len(TAGS)))
                                late[r] += step
                                late[g] -= step
                        if (last_g, g) != (last_r, r):
                            m[last_r, r] += 1
                            m[last_g, g] -= 1
                            late_m[last_r, r] += step
                            late_m[last_g, g] -= step
                        last_g, last_r = g, r
        keys = list(late_w)
        change = [(w[k] - weights[k] - late_w[k] / step).tolist() for k in keys]
        change.append((m - moves - late_m / step).ravel().tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*keys, -1], pa.int32()), pa.array(change, pa.list_(pa.float64()))], ["feature", "change"])

    return run


def fit(
    labelled: DataFrame, text: str = "text", spans: str = "spans", max_rows: int | None = None,
    epochs: int = EPOCHS, shards: int = SHARDS,
) -> Tagger:
    """Learn from texts with the spans (start, end, label PERSON or GPE) of their names, on all of them,
    dealt and ordered by a hash of the text: the same rows give the same model. Only a caller that
    sets `max_rows` learns from so many at most. `shards` is the least number of them."""
    given = labelled.select(F.col(text).alias("text"), F.col(spans).alias("spans")).where(F.col("text").isNotNull())
    if max_rows is not None:
        given = given.orderBy(F.xxhash64("text")).limit(max_rows)
    # copies of a row are counted and dealt over the shards, as one text may be a large share of all rows
    counted = written(given.groupBy("text", "spans").agg(F.count("*").alias("n")), "tagger-texts")
    shards = max(shards, -(-(counted.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS))
    copies = counted.select("text", "spans", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_copy"))
    rows = written(copies.select("text", "spans", F.pmod(
        F.xxhash64("text", F.lit(1)) + F.col("_copy"), F.lit(shards)).cast("int").alias("_shard")), "tagger-rows")
    weights = np.zeros((FEATURES, len(TAGS)))
    moves = np.zeros((len(TAGS) + 1, len(TAGS)))
    for epoch in range(epochs):
        dealt = rows.repartitionById(shards, F.col("_shard")).sortWithinPartitions(
            F.xxhash64("text", F.lit(epoch))).select("text", "spans")
        changed = dealt.mapInArrow(_pass(weights, moves), "feature int, change array<double>")
        # at most FEATURES + 1 rows
        mean = changed.select("feature", F.posexplode("change").alias("k", "c")).groupBy("feature", "k").agg(
            (F.sum("c") / shards).alias("c")).toArrow()
        feature, k, c = (mean.column(n).to_numpy() for n in ("feature", "k", "c"))
        plain = feature >= 0
        np.add.at(weights, (feature[plain], k[plain]), c[plain])
        moves = moves + np.bincount(k[~plain], c[~plain], moves.size).reshape(moves.shape)
    return Tagger(weights.astype(np.float32), moves)


# -- places of a table -------------------------------------------------------------------

WORDS = 4


def known_places(
    units: DataFrame, places: DataFrame, keys: list[str], text: str = "text", out: str = "entities",
) -> DataFrame:
    """`units` with a column of the places (`places`: name) that stand in the text as whole words, as
    (start, end, label GPE). Stretches of one to four words that begin with a capital are joined with
    the table, however large it is; `units` is best a written table, and `keys` identify its rows."""
    names = places.select(F.col("name").alias("_name")).where("_name IS NOT NULL").distinct()

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, starts = [], [], []
            for i, value in enumerate(batch.column(batch.schema.get_field_index("_text")).to_pylist()):
                words = [t for t in tokens(value or "") if t[2] != "\n"]
                for a, (start, _, word) in enumerate(words):
                    if word[:1].isupper():
                        for _, end, _ in words[a : a + WORDS]:
                            rows.append(i)
                            values.append(value[start:end])
                            starts.append(start)
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(k)).take(at) for k in keys),
                     pa.array(values), pa.array(starts, pa.int32())], [*keys, "_name", "start"])

    given = units.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in given.select(*keys).dtypes) + ", _name string, start int"
    hits = counted_join(written(given.mapInArrow(stretches, schema), "stretches"),
                        names.withColumn("_known", F.lit(True)), ["_name"], ["_known"])
    entity = F.struct("start", (F.col("start") + F.length("_name")).cast("int").alias("end"), F.lit("GPE").alias("label"))
    per_unit = hits.groupBy(*keys).agg(F.collect_set(entity).alias(out))
    joined = counted_join(units, per_unit, keys, [out], "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(ENTITIES)).cast(ENTITIES))
