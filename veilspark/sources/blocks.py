"""Files of any size as blocks, and Merkle trees over their blocks.

A Python Data Source deals out byte ranges: a task reads and hashes the blocks of its range one at a
time, so neither a task nor a value ever holds a file, and a huge file is read by many tasks. The
tree's nodes are a table: a changed block is found by walking down from the root, where only the
children of nodes that differ are looked at.

A leaf is SHA-256 of the byte 0 and the block, a node SHA-256 of the byte 1 and its children in
order, at most `FANOUT` of them; so no node can be passed off as a block. A file without a byte has
one empty block.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.skew import written
from ..sinks.files import file_system

BLOCK = 4 << 20
RANGE = 256 << 20  # bytes of a task
TASKS = 512
FANOUT = 64
SCHEMA = "file_id string, block bigint, n_bytes bigint, hash binary"


@dataclass
class _Ranges(InputPartition):
    """Byte ranges (file, below the folder, first block, blocks) of a task."""

    ranges: list[tuple[str, str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("blocksize", BLOCK))
        self.range = int(options.get("rangesize", RANGE))

    def partitions(self) -> list[_Ranges]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(self.path)
        files = []
        for info in fs.get_file_info(FileSelector(root, recursive=True)):
            name = posixpath.relpath(info.path, root)
            if info.type == FileType.File and not any(p.startswith(("_", ".")) for p in name.split("/")):
                files.append((info.path, name, max(1, -(-info.size // self.block))))
        # starting a task takes longer than hashing a few blocks: short ranges grow with the folder
        dealt = -(-sum(blocks for _, _, blocks in files) // TASKS) * self.block
        wanted = max(self.range, min(RANGE, dealt))
        out, held, size = [], [], 0
        per_range = max(1, wanted // self.block)
        for path, name, blocks in files:
            for first in range(0, blocks, per_range):
                n = min(per_range, blocks - first)
                held.append((path, name, first, n))
                size += n * self.block
                if size >= wanted:
                    out.append(_Ranges(held))
                    held, size = [], 0
        return [*out, _Ranges(held)] if held or not out else out

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for path, name, first, n in partition.ranges:
            with fs.open_input_file(path) as f:
                f.seek(first * self.block)
                for block in range(first, first + n):
                    data = f.read(self.block)
                    yield name, block, len(data), hashlib.sha256(b"\0" + data).digest()


class BlockSource(DataSource):
    """`spark.read.format("file_blocks").load(folder)`: a row per block of every file below the
    folder, names that begin with `_` or `.` apart. Options: blockSize, rangeSize in bytes. A task
    takes ranges of rangeSize together; where that made more than `TASKS` tasks, of up to `RANGE`."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK, range_size: int = RANGE) -> DataFrame:
    """(file_id, block, n_bytes, hash); file_id is the path below the folder."""
    spark.dataSource.register(BlockSource)
    reader = spark.read.format(BlockSource.name())
    return reader.option("blockSize", block).option("rangeSize", range_size).load(path)


def merkle(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file_id, level, node, n_bytes, hash): all nodes, level 0 the blocks. The node of a file with
    the highest level is its root. A job per level, and levels grow with the logarithm of the
    largest file; a node gathers at most `fanout` children."""
    level = written(blocks.select(
        "file_id", F.lit(0).alias("level"), F.col("block").alias("node"), "n_bytes", "hash"), "merkle-0")
    nodes, number = level, 0
    while True:
        above = level.groupBy("file_id").count().where("count > 1").select("file_id")
        open_files = level.join(above, "file_id", "left_semi")
        if open_files.isEmpty():
            return nodes
        number += 1
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        parent = F.expr(f"node div {int(fanout)}")
        joined = F.aggregate(children, F.lit(b"\x01"), lambda acc, c: F.concat(acc, c["hash"]))
        level = written(open_files.groupBy("file_id", parent.alias("above")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.unhex(F.sha2(joined, 256)).alias("hash"),
        ).select("file_id", F.lit(number).alias("level"), F.col("above").alias("node"), "n_bytes", "hash"),
            f"merkle-{number}")
        nodes = nodes.unionByName(level)


def roots(nodes: DataFrame) -> DataFrame:
    """(file_id, n_bytes, fingerprint): one row per file, however large."""
    top = F.struct("level", "n_bytes", "hash")
    return nodes.groupBy("file_id").agg(F.max(top).alias("top")).select(
        "file_id", F.col("top.n_bytes").alias("n_bytes"), F.lower(F.hex("top.hash")).alias("fingerprint"))


def changed_blocks(before: DataFrame, after: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file_id, block, change): blocks that differ between two trees of a folder, `changed`, `added`
    or `removed`. From the highest level down, and only below nodes that differ."""
    def side(nodes, name):
        return nodes.select("file_id", "level", "node", F.col("hash").alias(name))

    def differing(old, new):
        pairs = old.join(new, ["file_id", "node"], "full")
        return pairs.where(~F.col("old").eqNullSafe(F.col("new")))

    old, new = side(before, "old"), side(after, "new")
    tops = roots(before).select("file_id", F.col("fingerprint").alias("a")).join(
        roots(after).select("file_id", F.col("fingerprint").alias("b")), "file_id", "full")
    tops = tops.where(~F.col("a").eqNullSafe(F.col("b"))).select("file_id")
    heights = old.select("file_id", "level").unionByName(new.select("file_id", "level")).join(
        tops, "file_id", "left_semi").groupBy("file_id").agg(F.max("level").alias("height"))
    heights = written(heights, "merkle-heights")
    top = heights.agg(F.max("height")).first()[0] or 0
    frontier = None
    for level in range(top, -1, -1):
        # below what differs one level higher; a file enters at the height of its larger tree
        parents = heights.where(F.col("height") == level).select("file_id", F.lit(0).cast("bigint").alias("parent"))
        if frontier is not None:
            parents = parents.unionByName(frontier.select("file_id", F.col("node").alias("parent")))

        def below(nodes, name):
            here = nodes.where(F.col("level") == level).withColumn("parent", F.expr(f"node div {int(fanout)}"))
            return here.join(parents, ["file_id", "parent"], "left_semi").select("file_id", "node", name)

        frontier = written(differing(below(old, "old"), below(new, "new")), "merkle-frontier")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return frontier.select("file_id", F.col("node").alias("block"), change.alias("change"))
