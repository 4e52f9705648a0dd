"""Hard negatives by a secondary sort of pair scores.

Every anchor is scored against all rows, in blocks, and pairs that can matter are sent on under the
key (anchor, descending score, id). A shuffle on the anchor that sorts by the whole key inside its
partitions brings each anchor's pairs in order; an iterator reads them once: a positive opens a
window of scores, each window takes the next negatives that lie in it and closes when it is full or
the scores have fallen below it. Nothing of an anchor is held but its open windows.

Pairs are thinned out exactly before they are sent: of a block only the first positives can be among
an anchor's first ones. Once these are known (a first pass), so are the windows, and of a block only
the first negatives of each window can be among the window's first ones (a second pass). What is sent
thus grows with anchors and blocks, not with anchors and rows, and labels are never a key: a label
that holds a third of all rows is in every block like others.

The cases are those of `vectors`; rows with a null label take no part either. An anchor without
other rows of its label has no result; fewer positives or negatives than asked for: all of them. A
positive with a score below zero has an empty window, as 30 p > 90 p.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, stage
from .vectors import GROUP_ROWS, best, block_rows, past_blocks, products, whole_vectors

EVERY = 100
POSITIVES = 5
NEGATIVES = 10
# A window in hundredths of the positive's score.
LOW, HIGH = 30, 90
PAIR = "anchor bigint, anchor_id bigint, down bigint, vec_id bigint, same boolean"


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The lowest and highest whole score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _batch(anchors, anchor_ids, scores, ids, same) -> pa.RecordBatch:
    arrays = [pa.array(anchors, pa.int64()), pa.array(anchor_ids, pa.int64()),
              pa.array(-np.asarray(scores, np.int64)), pa.array(ids, pa.int64()),
              pa.array(np.full(len(ids), same))]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "anchor_id", "down", "vec_id", "same"])


def _positives(k: int):
    """First rows of an anchor's label in a block."""

    def open_block(ids, labels, vectors):
        def group(table: pa.Table, anchors: np.ndarray):
            own, label = (table.column(c).combine_chunks().to_numpy() for c in ("vec_id", "label"))
            keys = table.column("anchor").combine_chunks().to_numpy()
            scores = products(anchors, vectors)
            rows, cols = np.nonzero((label[:, None] == labels) & (own[:, None] != ids))
            kept = best(rows, scores[rows, cols], ids[cols], k)
            rows, cols = rows[kept], cols[kept]
            return _batch(keys[rows], own[rows], scores[rows, cols], ids[cols], True)

        return group

    return open_block


def _negatives(k: int, low: int, high: int):
    """First rows of other labels in a block, for each window of an anchor."""

    def open_block(ids, labels, vectors):
        def group(table: pa.Table, anchors: np.ndarray):
            own, label = (table.column(c).combine_chunks().to_numpy() for c in ("vec_id", "label"))
            keys = table.column("anchor").combine_chunks().to_numpy()
            scores = products(anchors, vectors)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i, opened in enumerate(table.column("scores").to_pylist()):
                ranges = [window(s, low, high) for s in set(opened)]
                ranges = [r for r in ranges if r[0] <= r[1]]
                if not ranges:
                    continue
                line = scores[i]
                other = (labels != label[i]) & (ids != own[i])
                other &= (line >= min(r[0] for r in ranges)) & (line <= max(r[1] for r in ranges))
                cols = np.flatnonzero(other)
                cols = cols[np.lexsort((ids[cols], -line[cols]))]
                falling = -line[cols]
                taken = [cols[np.searchsorted(falling, -r[1]):np.searchsorted(falling, -r[0], "right")][:k]
                         for r in ranges]
                cols = np.unique(np.concatenate(taken))
                found.append((np.full(len(cols), i), cols))
            if not found:
                return None
            rows, cols = (np.concatenate(x) for x in zip(*found))
            return _batch(keys[rows], own[rows], scores[rows, cols], ids[cols], False)

        return group

    return open_block


class _Anchor:
    """The open windows of the anchor whose pairs are being read, in falling order of score."""

    def __init__(self, k: int, negatives: int, low: int, high: int):
        self.k, self.negatives, self.low, self.high = k, negatives, low, high
        self.seen, self.windows, self.zeros = 0, [], []

    def positive(self, vec_id: int, score: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen > self.k:
            return
        lowest, highest = window(score, self.low, self.high)
        if lowest > highest:
            return
        opened = [vec_id, score, lowest, highest, 0]
        self.windows.append(opened)
        if score == 0:  # the only window that holds its positive's own score: what came before it counts
            for other in self.zeros:
                yield self._take(opened, other, 0)

    def negative(self, vec_id: int, score: int) -> Iterator[tuple]:
        if score == 0 and len(self.zeros) < self.negatives:
            self.zeros.append(vec_id)
        for opened in self.windows:
            if opened[2] <= score <= opened[3] and opened[4] < self.negatives:
                yield self._take(opened, vec_id, score)
        self.windows = [w for w in self.windows if score >= w[2] and w[4] < self.negatives]

    @staticmethod
    def _take(opened: list, vec_id: int, score: int) -> tuple:
        opened[4] += 1
        return opened[0], opened[4], vec_id, opened[1], score


RESULT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
          "positive_score bigint, negative_score bigint")


def _reader(k: int, negatives: int, low: int, high: int):
    """Pairs in the order of their key, read once."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, state = None, None
        for batch in batches:
            out = []
            columns = [column(batch, c).to_pylist() for c in ("anchor", "anchor_id", "down", "vec_id", "same")]
            for key, anchor_id, down, vec_id, same in zip(*columns):
                if state is None or key != anchor:
                    anchor, state = key, _Anchor(k, negatives, low, high)
                pairs = state.positive(vec_id, -down) if same else state.negative(vec_id, -down)
                out += [(anchor_id, *pair) for pair in pairs]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def hard_negatives(
    table: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each row where `is_anchor` (a condition on the column `vec_id`) holds, and each of its
    first `positives` other rows of the same label, the first `negatives` rows of other labels whose
    score lies in the positive's window. First: highest score, then smallest id."""
    rows = stage(whole_vectors(table, id_col, vec_col, label_col).where("label IS NOT NULL"), "labelled")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows(n, dims)))
    data = rows.withColumn("block", F.pmod(F.xxhash64("vec", "vec_id"), F.lit(blocks)).cast("int"))
    asked = rows.where(is_anchor).dropDuplicates(["vec_id", "vec", "label"])
    asked = stage(asked.withColumn("anchor", F.xxhash64("vec_id", "vec", "label")), "anchors")
    groups = max(1, -(-asked.count() // GROUP_ROWS))
    part = F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")

    def everywhere(df):
        """The stated anchors against all rows, block by block."""
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        return df.withColumn("part", part).withColumn("block", every)

    near = past_blocks(data, everywhere(asked), blocks, ["anchor"], _positives(positives), PAIR)
    by_score = Window.partitionBy("anchor").orderBy("down", "vec_id")
    firsts = near.withColumn("_place", F.row_number().over(by_score)).where(F.col("_place") <= positives)
    firsts = stage(firsts.drop("_place"), "positives")
    opened = firsts.groupBy("anchor").agg(F.collect_list(-F.col("down")).alias("scores"))
    sent = everywhere(asked.join(opened, "anchor"))
    far = past_blocks(data, sent, blocks, ["anchor", "scores"], _negatives(negatives, low, high), PAIR)
    # the secondary sort: dealt by anchor, sorted by (anchor, descending score, id)
    pairs = firsts.unionByName(far).repartition("anchor").sortWithinPartitions(
        "anchor", "down", "vec_id", F.col("same").desc())
    return map_arrow(pairs, _reader(positives, negatives, low, high), RESULT)


def mine(table: DataFrame, every: int = EVERY, **options) -> DataFrame:
    """`hard_negatives` with the rows whose id is divisible by `every` as anchors."""
    return hard_negatives(table, F.col("vec_id") % every == 0, **options)
