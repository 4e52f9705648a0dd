"""Toxicity by a bag of subwords.

A word is the mean of the vectors of its character n-grams (3 to 5, with word ends marked), a
passage of up to 8 words the mean of its words, and a linear softmax tells toxic passages from
others. Vectors and softmax are trained together in numpy. An unseen misspelling shares most
n-grams with the word it comes from, and so its vector.

Labels belong to documents, not to passages: training uses, of a toxic document, the passage
that looks most toxic so far (at first by the log-odds of its words), and of other documents
both random passages and those that look most toxic. A document's score is that of its most
toxic passage, calibrated on the training documents; every passage of the whole text counts.

The model is linear up to the softmax, so a word needs one number when scoring: the mean of
its n-grams' projections. Tasks remember it per word.

Cases. Null or empty text, or no word: the score of the lowest evidence, near 0. No labels of
one kind: every score is 0. Repeated rows score alike. Empty table: empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, take_columns, texts

BUCKETS = 1 << 16  # hashed n-grams
DIMENSIONS = 8
PASSAGE = 8  # words
ROUNDS, EPOCHS, BATCH = 3, 10, 256
RATE = 0.5
SEED = 5
MAX_LABELLED = 1500  # labelled documents per class used for training
REMEMBERED = 150_000  # words whose number a worker remembers
THRESHOLD = 0.7

_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased words; a word said again and again at once counts once."""
    words = _WORDS.findall(text.lower())
    return [w for w, before in zip(words, ["", *words]) if w != before]


def subwords(word: str) -> list[int]:
    """Buckets of the character n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [
        zlib.crc32(marked[i : i + n].encode()) % BUCKETS
        for n in (3, 4, 5) for i in range(max(1, len(marked) - n + 1))
    ]


def passage_means(values: np.ndarray) -> np.ndarray:
    """Mean value of every passage: all runs of 8 words; a shorter text is one passage,
    filled up with neutral words."""
    if len(values) <= PASSAGE:
        return values.sum(keepdims=True) / PASSAGE
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[PASSAGE:] - total[:-PASSAGE]) / PASSAGE


class Model(NamedTuple):
    projection: np.ndarray  # of each n-gram bucket on (toxic - other)
    slope: float  # calibration of a document's largest passage value
    offset: float

    def probability(self, top: float | None) -> float:
        z = self.offset + (self.slope * top if top is not None else -abs(self.slope) * 10)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Bags:
    """Sampled documents as word numbers, and words as n-gram buckets."""

    def __init__(self, documents: list[list[str]]):
        names: dict[str, int] = {}
        self.docs = [np.array([names.setdefault(w, len(names)) for w in d], np.int32) for d in documents]
        grams = [subwords(w) for w in names]
        self.sizes = np.array([len(g) for g in grams], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.grams = np.fromiter((g for gs in grams for g in gs), np.int32, int(self.ends[-1]))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of the given words, flat, and where each word begins."""
        sizes = self.sizes[words]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(begins[-1]) - np.repeat(begins[:-1] - self.ends[words], sizes)
        return self.grams[at], begins[:-1]

    def word_values(self, projection: np.ndarray) -> np.ndarray:
        return np.add.reduceat(projection[self.grams], self.ends[:-1]) / self.sizes


def _passages(bags: _Bags, toxic: np.ndarray, values: np.ndarray, rng) -> tuple[list[np.ndarray], np.ndarray]:
    """Training passages and their labels under the present word values."""
    out, labels = [], []
    for words, label in zip(bags.docs, toxic):
        if not len(words):
            continue
        means = passage_means(values[words])
        starts = {int(means.argmax())}
        if not label:
            starts.update(rng.integers(0, len(means), 3).tolist())
        for s in sorted(starts):
            out.append(words[s : s + PASSAGE])
            labels.append(label)
    return out, np.array(labels, np.float64)


def train(documents: list[str], toxic: list[int]) -> Model:
    """Fit vectors, softmax and calibration; deterministic for a given order of documents."""
    labels = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, -40.0)
    rng = np.random.default_rng(SEED)
    split = [words_of(t) for t in documents]
    bags = _Bags(split)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full((DIMENSIONS, 2), 1e-8), np.full(2, 1e-8)

    # word log-odds by document frequency point to the first passages
    n = len(bags.sizes)
    counts = np.ones((2, n)) * 0.5
    for words, label in zip(bags.docs, labels):
        counts[label, np.unique(words)] += 1
    per_class = np.bincount(labels, minlength=2) + 1
    values = np.log(counts[1] / per_class[1]) - np.log(counts[0] / per_class[0])

    for _ in range(ROUNDS):
        passages, wanted = _passages(bags, labels, values, rng)
        share = wanted.mean()
        cost = np.where(wanted == 1, 0.5 / share, 0.5 / (1 - share))  # both classes weigh alike
        for _ in range(EPOCHS):
            order = rng.permutation(len(passages))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                lengths = np.array([len(passages[i]) for i in chosen])
                words, place = np.unique(np.concatenate([passages[i] for i in chosen]), return_inverse=True)
                grams, begins = bags.of(words)
                word_vectors = np.add.reduceat(vectors[grams], begins) / bags.sizes[words, None]
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                mean = np.add.reduceat(word_vectors[place], first) / PASSAGE
                z = mean @ weights + bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                y = wanted[chosen].astype(int)
                p[np.arange(len(y)), y] -= 1
                p *= (cost[chosen] / len(y))[:, None]
                # backwards: softmax, passage mean, word mean, n-gram vectors
                g_w, g_b, g_mean = mean.T @ p, p.sum(axis=0), p @ weights.T
                spread = np.repeat(g_mean / PASSAGE, lengths, axis=0)
                g_words = np.stack([np.bincount(place, spread[:, k], len(words)) for k in range(DIMENSIONS)], 1)
                per_gram = np.repeat(g_words / bags.sizes[words, None], bags.sizes[words], axis=0)
                used, gram_place = np.unique(grams, return_inverse=True)
                g_v = np.stack([np.bincount(gram_place, per_gram[:, k], len(used)) for k in range(DIMENSIONS)], 1)
                seen_v[used] += (g_v**2).mean(axis=1)
                seen_w += g_w**2
                seen_b += g_b**2
                vectors[used] -= RATE * g_v / np.sqrt(seen_v[used])[:, None]
                weights -= 0.1 * RATE * g_w / np.sqrt(seen_w)
                bias -= 0.1 * RATE * g_b / np.sqrt(seen_b)
        # an n-gram that training never met says nothing
        projection = np.where(seen_v > 1e-8, vectors @ (weights[:, 1] - weights[:, 0]), 0.0)
        values = bags.word_values(projection)

    offset = float(bias[1] - bias[0])
    tops = np.array([passage_means(values[d]).max() if len(d) else np.nan for d in bags.docs])
    known = ~np.isnan(tops)
    slope, at = _calibrate(tops[known] + offset, labels[known])
    return Model(projection.astype(np.float32), slope, at + slope * offset)


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of one variable by Newton's method, with a weak prior."""
    scale = max(float(np.std(x)), 1e-6)
    u, a, b = x / scale, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * u).sum() + 0.05 * a, (p - y).sum()])
        hess = np.array([[(w * u * u).sum() + 0.05, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(a / scale), float(b)


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, fold_ok, max_per_class: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """text and label of a bounded sample: per class the labelled ids that come first by hash
    (at most `max_per_class`), so the broadcast side has a fixed bound of rows."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label"))
    known = known.where(F.col("_id").isNotNull() & fold_ok(F.col("_id"))).dropDuplicates(["_id"])
    parts = [
        known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class)
        for k in (0, 1)
    ]
    rows = take_columns(docs, doc_id=id_col, text=text_col)
    return rows.join(F.broadcast(parts[0].union(parts[1])), F.col("doc_id") == F.col("_id"))


def fit(docs: DataFrame, labels: DataFrame, fold_ok, max_per_class: int = MAX_LABELLED) -> Model:
    """Train on the sampled labelled documents for which `fold_ok(doc_id)` holds."""
    sample = labelled(docs, labels, "toxic", fold_ok, max_per_class)
    rows = sample.select("_id", F.coalesce("text", F.lit("")).alias("text"), "_label").collect()
    rows.sort(key=lambda r: (r._id, r.text))
    return train([r.text for r in rows], [int(r._label) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row. One narrow pass; the model is 256 KB."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)
    packed = (model.projection.tobytes(), model.slope, model.offset)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, own = _scorer(*packed), []
        for text in texts(batch):
            words = words_of(text)
            top = None
            if words:
                top = float(passage_means(np.fromiter(map(value, words), np.float64, len(words))).max())
            own.append(Model(None, *packed[1:]).probability(top))
        return pa.record_batch([column(batch, "doc_id"), pa.array(own, pa.float64())], ["doc_id", "score"])

    return map_batches(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


@functools.lru_cache(maxsize=1)
def _scorer(projection: bytes, slope: float, offset: float):
    table = np.frombuffer(projection, np.float32).tolist()

    @functools.lru_cache(maxsize=REMEMBERED)
    def value(word: str) -> float:
        grams = subwords(word)
        return sum(table[g] for g in grams) / len(grams)

    return value
