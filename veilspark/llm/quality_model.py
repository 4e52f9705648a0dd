"""Document quality by a factorisation machine.

Inputs are the hashed distinct words of a text, statistics of its structure in bins, and its
length in bins as the one metadatum a score may use. Every pair of inputs interacts through the
dot product of two short vectors, and all pairs together cost linear time: half of the square
of the sum minus the sum of the squares, per dimension.

Weights are trained in numpy with Adagrad on a bounded sample of labelled documents.

Cases. Null or empty text: the inputs of an empty structure, scored like any other. No labels
of one kind: every score is 0.5. Repeated rows score alike. Very long texts are read whole.
Empty table: empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, take_columns, texts
from .toxicity import labelled

BUCKETS = 1 << 15  # hashed words; inputs of structure follow
BINS = 8
DIMENSIONS = 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.15, 1e-5
SEED = 3
MAX_LABELLED = 2000  # labelled documents per class used for training
THRESHOLD = 0.3

# Upper bounds of the bins of each statistic; the last bin is open.
EDGES = {
    "symbols_per_word": (0.001, 0.02, 0.05, 0.1, 0.3, 1, 2),
    "bars_per_word": (0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.45),
    "capitals": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "shouts_per_word": (0.001, 0.01, 0.05, 0.1, 0.3, 0.6, 0.9),
    "digits": (0.0005, 0.002, 0.01, 0.03, 0.1, 0.2, 0.4),
    "distinct_words": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8),
    "commonest_word": (0.02, 0.04, 0.06, 0.1, 0.2, 0.4, 0.6),
    "repeated_lines": (0.001, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7),
    "same_neighbours": (0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 11),
    "stops_per_word": (0.005, 0.02, 0.04, 0.07, 0.12, 0.2, 0.4),
    "words_per_line": (2, 5, 10, 20, 40, 80, 160),
    "log_words": (2, 4, 5, 6, 7, 8.5, 10),
}
INPUTS = BUCKETS + BINS * len(EDGES)

_SYMBOL = re.compile(r"[#*$%&<>{}\[\]\\^~=_]")
_STRIP = " \t.,;:!?\"'()[]{}#*$%&|<>"


def statistics(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    """The measures of structure that `EDGES` puts into bins."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words)) or 1
    return {
        "symbols_per_word": len(_SYMBOL.findall(text)) / n,
        "bars_per_word": text.count("|") / n,
        "capitals": len(re.findall("[A-ZÀ-ÖØ-Þ]", text)) / chars,
        "shouts_per_word": text.count("!") / n,
        "digits": len(re.findall("[0-9]", text)) / chars,
        "distinct_words": len(counts) / n,
        "commonest_word": max(counts.values(), default=0) / n,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "same_neighbours": sum(map(str.__eq__, words, words[1:])) / n,
        "word_length": letters / n,
        "stops_per_word": len(re.findall(r"[.?;:](?=\s|$)", text)) / n,
        "words_per_line": len(words) / max(1, len(lines)),
        "log_words": math.log2(1 + len(words)),
    }


@functools.lru_cache(maxsize=150_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.strip(_STRIP).lower().encode()) % BUCKETS


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's inputs: each distinct word alike, together of length 1;
    each bin that applies with 1."""
    words = text.split()
    counts = Counter(words)
    hashed = sorted(set(map(_bucket, counts)))
    measured = statistics(text, words, counts)
    bins = [
        BUCKETS + k * BINS + int(np.searchsorted(edges, measured[name], side="right"))
        for k, (name, edges) in enumerate(EDGES.items())
    ]
    value = 1 / math.sqrt(len(hashed)) if hashed else 0.0
    at = np.array(hashed + bins, np.int32)
    return at, np.array([value] * len(hashed) + [1.0] * len(bins), np.float32)


class Model(NamedTuple):
    bias: float
    linear: np.ndarray  # INPUTS
    factors: np.ndarray  # INPUTS x DIMENSIONS

    def probability(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.bias + float(self.linear[at] @ x) + pairs
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float) -> Model:
    """Fit the machine; both classes weigh alike while training, then the bias is moved to the
    given share of label 1. Deterministic for a given order of samples."""
    y = np.array(labels, np.float64)
    linear, rng = np.zeros(INPUTS), np.random.default_rng(SEED)
    if len(set(labels)) < 2:
        return Model(0.0, linear.astype(np.float32), np.zeros((INPUTS, DIMENSIONS), np.float32))
    factors = rng.normal(0, 0.02, (INPUTS, DIMENSIONS))
    bias, seen_b = 0.0, 1e-6
    seen_l, seen_f = np.full(INPUTS, 1e-6), np.full(INPUTS, 1e-6)
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            sizes = np.array([len(samples[i][0]) for i in chosen])
            at = np.concatenate([samples[i][0] for i in chosen])
            x = np.concatenate([samples[i][1] for i in chosen]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = factors[at] * x[:, None]
            total = np.add.reduceat(vx, first)
            z = bias + np.add.reduceat(linear[at] * x, first)
            z += 0.5 * (total**2 - np.add.reduceat(vx**2, first)).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = (p - y[chosen]) * cost[chosen] / len(chosen)
            each = np.repeat(g, sizes) * x
            used, place = np.unique(at, return_inverse=True)
            g_l = np.bincount(place, each, len(used)) + DECAY * linear[used]
            inner = each[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            g_f = np.stack([np.bincount(place, inner[:, k], len(used)) for k in range(DIMENSIONS)], 1)
            g_f += DECAY * factors[used]
            seen_l[used] += g_l**2
            seen_f[used] += (g_f**2).mean(axis=1)
            seen_b += g.sum() ** 2
            linear[used] -= RATE * g_l / np.sqrt(seen_l[used])
            factors[used] -= 0.3 * RATE * g_f / np.sqrt(seen_f[used])[:, None]
            bias -= RATE * g.sum() / math.sqrt(seen_b)
    bias += math.log(prior / (1 - prior))
    return Model(float(bias), linear.astype(np.float32), factors.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, fold_ok, max_per_class: int = MAX_LABELLED) -> Model:
    """Train on the sampled labelled documents for which `fold_ok(doc_id)` holds. Inputs are
    made in tasks; the share of label 1 is taken over all usable labels."""
    usable = labels.where(F.col("doc_id").isNotNull() & fold_ok(F.col("doc_id")) & F.col("quality").isin(0, 1))
    share = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    rows = labelled(docs, labels, "quality", fold_ok, max_per_class).select("_id", "_label", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [inputs(t) for t in texts(batch)]
        return pa.record_batch(
            [column(batch, "_id"), column(batch, "_label").cast(pa.int64()),
             pa.array([a.tobytes() for a, _ in made], pa.binary()),
             pa.array([x.tobytes() for _, x in made], pa.binary())], ["_id", "_label", "at", "x"])

    kind = dict(rows.dtypes)["_id"]
    made = map_batches(rows, run, f"_id {kind}, _label bigint, at binary, x binary").collect()
    made.sort(key=lambda r: (r._id, bytes(r.at)))
    samples = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32)) for r in made]
    prior = min(0.99, max(0.01, share)) if share is not None else 0.5
    return train(samples, [int(r._label) for r in made], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row. One narrow pass; the model is about 1.2 MB."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = shared.value
        own = [machine.probability(*inputs(t)) for t in texts(batch)]
        return pa.record_batch([column(batch, "doc_id"), pa.array(own, pa.float64())], ["doc_id", "score"])

    return map_batches(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
