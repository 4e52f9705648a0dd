"""Exact top-k search by inner product: cover trees of queries and of data, searched together.

For a query node with centre p and covering radius r, and a data node with centre c and radius s,
no product between them exceeds <p, c> + r|c| + s|p| + rs (Cauchy-Schwarz on both offsets). A pair
of nodes is passed over when this is below the worst kth score of the queries under the node.

1. The top of the index is fitted on a bounded sample: farthest-first centres, at most `CENTRES`
   (nested nets, the upper levels of a cover tree). Every row then goes to its nearest centre, and
   the covering radii are taken over all rows.
2. Rows of a centre are dealt into blocks, a centre that holds a third of all rows into many. A task
   makes cover trees of at most `TREE_ROWS` rows of its block, and a tree of each query group.
3. First each query group searches one block of its own centre: this gives its kth scores. Pairs of
   centres that cannot beat the worst of them are then dropped, and the queries search all blocks
   left, from these scores on; the k best of what the blocks return are the result.

Scores are compared as whole numbers, bounds as doubles with slack on the safe side; equal scores
are kept until ids decide. On vectors without structure few pairs are dropped and the search is a
blocked product of queries and rows; memory stays bounded either way.

The cases are those of `vectors`. Fewer than k other rows: all of them. No queries: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_batches, stage
from .vectors import (
    GROUP_ROWS, best, block_rows, matrix, norms, past_blocks, products, whole_vectors, widen,
)

K = 5
EVERY = 50
SAMPLE_ROWS = 2_048  # rows on which the centres are fitted, fewer if they hold over SAMPLE_BYTES
SAMPLE_BYTES = 4 << 20
CENTRES = 256
ROWS_PER_CENTRE = 8_192
TREE_ROWS = 1_024
SLACK = 1e-9


# -- cover tree -----------------------------------------------------------------------

@dataclass
class Node:
    """Points lo:hi of the tree's order. `kids` are rows of matrices, so that all children of
    two nodes are compared at once; a leaf is one point."""

    lo: int
    hi: int
    kids: list = field(default_factory=list)
    centres: np.ndarray | None = None  # places in the order of the tree
    radii: np.ndarray | None = None


class CoverTree:
    """Nested nets: the children of a node with radius r are centres more than r/2 apart, which
    cover its points within r/2. Radii are measured, not assumed."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.zeros(len(vectors), np.int64)
        self.filled = 0
        self.given = vectors
        squares = norms(vectors) ** 2
        if len(vectors):
            gaps = squares[:, None] + squares[None, :] - 2 * products(vectors, vectors).astype(np.float64)
            self.gaps = np.sqrt(np.maximum(gaps, 0))
            self.root = self._node(np.arange(len(vectors)), 0)
            del self.gaps
        self.vectors = vectors[self.order]
        self.norms = norms(self.vectors)

    def _node(self, points: np.ndarray, centre: int) -> Node:
        """`points` are numbered as given; `centre` is one of them."""
        node = Node(self.filled, self.filled + len(points))
        if len(points) == 1:
            self.order[self.filled] = points[0]
            self.filled += 1
            node.kids = [node]
            node.centres, node.radii = np.array([node.lo]), np.zeros(1)
            return node
        away = self.gaps[centre, points]
        limit = away.max() / 2
        groups = []
        if limit <= 0:  # equal points: all of them leaves
            groups = [(np.array([p]), p) for p in points]
        else:
            left, centre_now = points, centre
            while len(left):
                near = self.gaps[centre_now, left] <= limit
                near |= left == centre_now
                groups.append((left[near], centre_now))
                left = left[~near]
                centre_now = left[0] if len(left) else None
        centres, radii = [], []
        for members, c in groups:
            members = np.r_[c, members[members != c]]
            kid = self._node(members, c)
            node.kids.append(kid)
            centres.append(kid.lo)  # the centre is the first point of its node
            radii.append(self.gaps[c, members].max() if len(members) > 1 else 0.0)
        node.centres, node.radii = np.array(centres), np.array(radii)
        return node


def bounds(dots, a_norm, a_radius, b_norm, b_radius) -> np.ndarray:
    """Upper bounds of the products between points of two sets of nodes."""
    top = (dots + a_radius[:, None] * b_norm + a_norm[:, None] * b_radius
           + a_radius[:, None] * b_radius)
    reach = (a_norm + a_radius)[:, None] * (b_norm + b_radius)
    return top + SLACK * reach + 1


class Search:
    """k best data rows of each query of one group, over any number of data trees."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int):
        self.k, self.tree = k, CoverTree(queries)
        self.ids, self.floors = ids[self.tree.order], floors[self.tree.order].astype(np.float64)
        self.rows = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)

    def add(self, tree: CoverTree, ids: np.ndarray) -> None:
        if not len(self.ids) or not len(ids):
            return
        todo = [(self.tree.root, tree.root, np.inf)]
        while todo:
            a, b, bound = todo.pop()
            if bound >= self.floors[a.lo:a.hi].min():
                todo += self._compare(a, b, tree, ids)

    def _compare(self, a: Node, b: Node, tree: CoverTree, ids: np.ndarray) -> list:
        dots = products(self.tree.vectors[a.centres], tree.vectors[b.centres])
        leaf = (a.radii == 0)[:, None] & (b.radii == 0)
        # nodes of equal points have radius 0 too, but are no leaves
        leaf &= np.array([x.hi - x.lo == 1 for x in a.kids])[:, None]
        leaf &= np.array([x.hi - x.lo == 1 for x in b.kids])
        rows, cols = np.nonzero(leaf & (dots >= self.floors[a.centres][:, None]))
        rows_at = a.centres[rows]
        other = ids[b.centres[cols]] != self.ids[rows_at]
        if other.any():
            self._keep(rows_at[other], dots[rows, cols][other], ids[b.centres[cols]][other])
        if leaf.all():
            return []
        top = bounds(dots, self.tree.norms[a.centres], a.radii, tree.norms[b.centres], b.radii)
        worst = np.array([self.floors[x.lo:x.hi].min() for x in a.kids])
        rows, cols = np.nonzero(~leaf & (top >= worst[:, None]))
        order = np.argsort(top[rows, cols])  # the most promising pair is taken first
        return [(a.kids[i], b.kids[j], top[i, j]) for i, j in zip(rows[order], cols[order])]

    def _keep(self, rows, scores, ids) -> None:
        rows, scores = np.r_[self.rows, rows], np.r_[self.scores, scores]
        ids = np.r_[self.found, ids]
        kept = best(rows, scores, ids, self.k)
        self.rows, self.scores, self.found = rows[kept], scores[kept], ids[kept]
        full, counts = np.unique(self.rows, return_counts=True)
        full = full[counts == self.k]
        worst = np.full(len(self.floors), np.inf)
        np.minimum.at(worst, self.rows, self.scores)
        self.floors[full] = np.maximum(self.floors[full], worst[full])


def _trees(ids: np.ndarray, vectors: np.ndarray) -> list[tuple[CoverTree, np.ndarray]]:
    out = []
    for at in range(0, len(ids), TREE_ROWS):
        tree = CoverTree(vectors[at : at + TREE_ROWS])
        out.append((tree, ids[at : at + TREE_ROWS][tree.order]))
    return out


def _searcher(k: int, only_floors: bool):
    """What a task does with a block: trees once, then group after group of queries."""

    def open_block(ids, labels, vectors):
        trees = _trees(ids, vectors)

        def group(table: pa.Table, queries: np.ndarray):
            keys = table.column("query").combine_chunks().to_numpy()
            floors = table.column("floor").combine_chunks().fill_null(float("-inf")).to_numpy()
            search = Search(queries, table.column("vec_id").combine_chunks().to_numpy(), floors, k)
            for tree, tree_ids in trees:
                search.add(tree, tree_ids)
            order = search.tree.order
            if only_floors:
                full, counts = np.unique(search.rows, return_counts=True)
                full = full[counts == k]
                worst = np.full(len(order), np.inf)
                np.minimum.at(worst, search.rows, search.scores.astype(np.float64))
                columns = [pa.array(keys[order[full]]), pa.array(worst[full])]
                return pa.RecordBatch.from_arrays(columns, ["query", "floor"])
            columns = [keys[order[search.rows]], search.ids[search.rows], search.found, search.scores]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "score"])

        return group

    return open_block


# -- index ------------------------------------------------------------------------------

def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Places of at most n distinct rows, each the farthest from those before it."""
    if not len(sample):
        return np.zeros(0, np.int64)
    squares = norms(sample) ** 2
    chosen, away = [0], np.full(len(sample), np.inf)
    while len(chosen) < n:
        last = chosen[-1]
        dots = products(sample[last : last + 1], sample)[0].astype(np.float64)
        away = np.minimum(away, squares + squares[last] - 2 * dots)
        if away.max() <= 0:
            break
        chosen.append(int(away.argmax()))
    return np.array(chosen)


def _assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each row with its nearest centre and the distance to it."""
    squares = norms(centres) ** 2

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = matrix(column(batch, "vec"))
        gaps = (squares - 2 * products(vectors, centres).astype(np.float64)
                + (norms(vectors) ** 2)[:, None])
        cell = gaps.argmin(axis=1)
        away = np.sqrt(np.maximum(gaps[np.arange(len(cell)), cell], 0))
        # rounding of the squares, on the safe side
        away += 1e-7 * (norms(vectors) + np.sqrt(squares)[cell]) + 1e-6
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)],
            [*batch.schema.names, "cell", "away"])

    return map_batches(rows, nearest, "vec_id bigint, label bigint, vec array<bigint>, cell int, away double")


def _pairs(centres, radius, asked, worst) -> np.ndarray:
    """Which pairs (cell of queries, cell of rows) can hold a result."""
    dots = products(centres, centres).astype(np.float64)
    size = norms(centres)
    return bounds(dots, size, asked, size, radius) >= worst[:, None]


def _table(spark, values: dict, schema: str) -> DataFrame:
    """A table of at most CENTRES² rows made by the driver."""
    return spark.createDataFrame(list(zip(*values.values())), schema)


def search(
    table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest products for every row
    where `is_query` (a condition on the column `vec_id`) holds. Equal scores: the smaller id."""
    spark = table.sparkSession
    rows = stage(whole_vectors(table, id_col, vec_col), "vectors")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dims, 1))))
    shuffled = F.xxhash64("vec_id", "vec")
    picked = rows.orderBy(shuffled, "vec_id").limit(size).select("vec").toArrow()
    sample = matrix(picked.column("vec").combine_chunks()) if picked.num_rows else np.zeros((0, dims), np.int64)
    wanted = max(1, min(CENTRES, n // ROWS_PER_CENTRE))
    centres = widen(sample, dims)[farthest_first(sample, wanted)]
    if not len(centres):
        centres = np.zeros((1, dims), np.int64)

    placed = stage(_assign(rows, centres), "cells")
    per_block = block_rows(n, dims)
    queries = placed.where(is_query).dropDuplicates(["vec_id", "vec"])
    asked = stage(queries.withColumn("query", F.xxhash64("vec_id", "vec")), "queries")
    cells = len(centres)
    counts, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        counts[r.cell], radius[r.cell] = r.n, r.r
    groups, asked_radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        groups[r.cell], asked_radius[r.cell] = -(-r.n // GROUP_ROWS), r.r
    blocks = -(-counts // per_block)
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    total = int(blocks.sum())
    layout = F.broadcast(_table(spark, {
        "cell": range(cells), "first": first.tolist(), "blocks": blocks.tolist(),
        "groups": groups.tolist(), "group0": np.r_[0, np.cumsum(groups)[:-1]].tolist(),
    }, "cell int, first int, blocks int, groups int, group0 int"))  # at most CENTRES rows

    spread = F.xxhash64(F.col("vec"), F.col("vec_id"))
    data = placed.join(layout, "cell").select(
        (F.col("first") + F.pmod(spread, F.col("blocks"))).cast("int").alias("block"),
        "vec_id", "label", "vec")
    grouped = asked.join(layout, "cell").withColumn(
        "part", (F.col("group0") + F.pmod(F.xxhash64("query"), F.col("groups"))).cast("int"))

    # one block of its own cell gives each query its first kth score
    own = (F.col("first") + F.pmod(F.col("part"), F.col("blocks"))).cast("int")
    seeds = grouped.withColumn("block", own).withColumn("floor", F.lit(None).cast("double"))
    floors = stage(past_blocks(data, seeds, total, ["query", "floor"], _searcher(k, True),
                               "query bigint, floor double"), "floors")
    known = grouped.join(floors, "query", "left")
    worst = np.full(cells, np.inf)
    lowest = F.min(F.coalesce("floor", F.lit(float("-inf"))))
    for r in known.groupBy("cell").agg(lowest.alias("w")).collect():
        worst[r.cell] = r.w
    left = _pairs(centres, radius, asked_radius, worst) & (blocks > 0) & (groups > 0)[:, None]
    ranges = [[(int(first[j]), int(first[j] + blocks[j] - 1)) for j in np.flatnonzero(row)] for row in left]
    reach = F.broadcast(_table(spark, {"cell": range(cells), "ranges": ranges},
                               "cell int, ranges array<struct<lo:int,hi:int>>"))
    sent = known.join(reach, "cell").select(
        F.explode("ranges").alias("r"), "part", "vec_id", "label", "vec", "query", "floor")
    sent = sent.withColumn("block", F.explode(F.sequence("r.lo", "r.hi")))
    found = past_blocks(data, sent, total, ["query", "floor"], _searcher(k, False),
                        "query bigint, query_id bigint, vec_id bigint, score bigint")
    by_score = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, k: int = K, every: int = EVERY, **columns: str) -> DataFrame:
    """`search` with the rows whose id is divisible by `every` as queries."""
    return search(table, F.col("vec_id") % every == 0, k, **columns)
