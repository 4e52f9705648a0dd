"""Vectors for exact search: whole components, blocks of rows, and queries streamed past them.

Shared by `topk` and `negatives`. Each component x becomes floor(256 * x), so inner products are
whole numbers. Rows are dealt into blocks of bounded size by a hash; the query rows go to every
block that may matter to them, in groups of bounded size. A task sorts what it gets by
(block, data before queries, group), holds one block and one group at a time and streams the rest:
memory does not grow with the table or with the number of queries.

Cases. A null vector, or one with a null or non-finite component, takes no part; nor does a row
without an id, which no result could name, nor a vector so long that products with it would not
fit a 64-bit integer (norm of 2^31 or more). Vectors of different lengths are compared over the
positions that both have. Rows that repeat an id are rows of their own for others, and are not
offered to a query with that id. Query rows that repeat id and vector are asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, map_arrow

SCALE = 256
NORM_LIMIT = float(1 << 62)  # of a squared norm
EXACT = float(1 << 53)  # whole numbers that doubles hold exactly
GROUP_ROWS = 256  # queries held at once
# Rows of a block: enough blocks for all cores of a small table, less traffic for a large one.
LEAST_ROWS, MOST_ROWS = 2_048, 65_536
BLOCK_BYTES = 32 << 20
MANY_BLOCKS = 1_000


def whole_vectors(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str | None = None,
) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, with whole components; no label column:
    null labels."""
    label = F.col(f"`{label_col}`") if label_col else F.lit(None)
    finite = F.forall(F.col(f"`{vec_col}`").cast("array<double>"), lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = table.where(finite).select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
        F.transform(F.col(f"`{vec_col}`").cast("array<double>"),
                    lambda x: F.floor(F.lit(float(SCALE)) * x)).alias("vec"))
    size = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(F.col("vec_id").isNotNull() & (size < NORM_LIMIT))


def block_rows(n: int, dims: int) -> int:
    """Rows of a block of a table of `n` rows, bounded in rows and bytes."""
    most = max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * max(dims, 1))))
    return min(most, max(LEAST_ROWS, n // MANY_BLOCKS))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix of whole numbers; shorter rows end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widen(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def stack(parts: list[np.ndarray]) -> np.ndarray:
    dims = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([widen(p, dims) for p in parts]) if parts else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two whole-number matrices, exactly, as int64. Doubles
    are used where they hold every partial sum (Cauchy-Schwarz), integers elsewhere."""
    dims = min(a.shape[1], b.shape[1])
    if not (a.size and b.size and dims):
        return np.zeros((len(a), len(b)), np.int64)
    if norms(a).max() * norms(b).max() < EXACT / 2:
        return (a[:, :dims].astype(np.float64) @ b[:, :dims].T.astype(np.float64)).astype(np.int64)
    return a[:, :dims] @ b[:, :dims].T


def norms(a: np.ndarray) -> np.ndarray:
    f = a.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", f, f))


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


# -- queries past blocks ----------------------------------------------------------------------

def past_blocks(
    data: DataFrame, queries: DataFrame, blocks: int, extra: list[str], fn: Callable,
    schema: StructType | str,
) -> DataFrame:
    """Run `fn(block, queries)` for every block and every group of queries sent to it.

    data     block, vec_id, label, vec: each row once
    queries  block, part (a group number within its block), vec_id, label, vec, and `extra`
    fn       makes a function of (ids, labels, vectors) of a block that takes a group as
             (record table, vectors) and returns a record batch or None
    """
    empty = {f.name: F.lit(None).cast(f.dataType) for f in queries.schema if f.name in extra}
    cols = ["block", "part", "vec_id", "label", "vec"]
    left = data.withColumn("part", F.lit(-1)).select(*cols, *[c.alias(n) for n, c in empty.items()])
    rows = left.unionByName(queries.select(*cols, *empty))
    # one partition per block: blocks are of one size, so are the tasks
    dealt = rows.repartitionById(max(1, blocks), F.col("block")).sortWithinPartitions("block", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, held_key = None, [], None

        def close():
            """What the rows gathered last are good for: a block, or one group of queries."""
            nonlocal scan, held
            if not held:
                return None
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = stack([matrix(column(b, "vec")) for b in held])
            held = []
            if held_key[1] < 0:
                ids = table.column("vec_id").combine_chunks().to_numpy()
                labels = table.column("label").combine_chunks().fill_null(0).to_numpy()
                scan = fn(ids, labels, vectors)
                return None
            return scan(table, vectors) if scan is not None else None

        for batch in batches:
            block = column(batch, "block").to_numpy()
            part = column(batch, "part").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
                if hi <= lo:
                    continue
                key = (block[lo], part[lo])
                if key != held_key:
                    out = close()
                    if out is not None and out.num_rows:
                        yield out
                    if held_key is None or key[0] != held_key[0]:
                        scan = None
                    held_key = key
                held.append(batch.slice(lo, hi - lo))
        out = close()
        if out is not None and out.num_rows:
            yield out

    return map_arrow(dealt, run, schema)
