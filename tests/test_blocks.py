"""Fingerprints of files of any size, and the blocks in which two states of a folder differ."""

import hashlib
import os

from pyspark.sql import functions as F

from veilspark.operators import govern
from veilspark.sources import blocks, catalog


def root(data, block, fanout):
    level = [hashlib.sha256(b"\0" + data[at:at + block]).digest() for at in range(0, max(len(data), 1), block)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[at:at + fanout])).digest() for at in range(0, len(level), fanout)]
    return level[0].hex()


def tree(spark, path, block=10, fanout=3):
    return blocks.merkle(blocks.read_blocks(spark, str(path), block, range_size=4 * block), fanout)


def test_roots(spark, tmp_path):
    contents = {"a.bin": os.urandom(995), "sub/b.bin": b"x" * 10, "c.bin": b"", "d.bin": b"y" * 11, "e.csv": b"z" * 30}
    (tmp_path / "sub").mkdir()
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_staged").write_bytes(b"not a file of the folder")
    got = {r.file_id: (r.n_bytes, r.fingerprint) for r in blocks.roots(tree(spark, tmp_path)).collect()}
    assert got == {name: (len(data), root(data, 10, 3)) for name, data in contents.items()}
    rows = catalog.catalog_of_any_size(spark, str(tmp_path), 7).collect()
    assert [(r.original_filename, r.n_bytes, r.status) for r in rows] == [("e.csv", 30, "uploaded")]


def test_changed_blocks(spark, tmp_path):
    def state(name, **contents):
        (tmp_path / name).mkdir()
        for file, data in contents.items():
            (tmp_path / name / file).write_bytes(data)
        return tree(spark, tmp_path / name)

    data = os.urandom(1000)
    moved = bytearray(data)
    moved[555] ^= 1
    before = state("a", same=data, one=data, longer=data[:305], shorter=data, gone=b"x" * 25, tiny=b"1")
    after = state("b", same=data, one=bytes(moved), longer=data, shorter=data[:20], new=b"y" * 15, tiny=b"2")
    got = {}
    for r in blocks.changed_blocks(before, after, 3).collect():
        got.setdefault(r.file_id, {}).setdefault(r.change, set()).add(r.block)
    assert got == {
        "one": {"changed": {55}}, "longer": {"changed": {30}, "added": set(range(31, 100))},
        "shorter": {"removed": set(range(2, 100))}, "gone": {"removed": {0, 1, 2}}, "new": {"added": {0, 1}},
        "tiny": {"changed": {0}}}
    assert blocks.changed_blocks(before, before, 3).collect() == []


def test_a_file_larger_than_one_value(spark, tmp_path):
    """Three GB without a byte on disk: a root, then one byte changes and its block is named."""
    path = tmp_path / "in" / "big.csv"
    path.parent.mkdir()
    size = 3 << 30
    with open(path, "wb") as f:
        f.truncate(size)
    assert catalog.oversized_files(spark, str(path.parent)).count() == 1
    read = blocks.read_blocks(spark, str(path.parent), 16 << 20)
    assert read.rdd.getNumPartitions() == 12
    before = blocks.merkle(read)
    row = blocks.roots(before).first()
    assert row.n_bytes == size and len(row.fingerprint) == 64
    with open(path, "r+b") as f:
        f.seek(100 * (16 << 20) + 5)
        f.write(b"!")
    after = blocks.merkle(blocks.read_blocks(spark, str(path.parent), 16 << 20))
    assert [tuple(r) for r in blocks.changed_blocks(before, after).collect()] == [("big.csv", 100, "changed")]
    files = blocks.roots(before).select(F.col("file_id").alias("original_path"), F.col("fingerprint").alias("file_hash"))
    now = blocks.roots(after).select(F.col("file_id").alias("path"), F.col("fingerprint").alias("hash"))
    assert [r.verdict for r in govern.integrity(files, now).collect()] == ["tampered"]


def test_short_ranges_of_a_large_folder(spark, tmp_path, monkeypatch):
    """Ranges of two blocks would make 10,975 tasks; far fewer read every block once."""
    contents = {"a.bin": os.urandom(40_003), "sub/empty.bin": b""}
    contents |= {f"sub/{k}.bin": b"x" * k for k in range(1, 600)}
    (tmp_path / "sub").mkdir()
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = sorted((name, at // 10, len(data[at:at + 10]), hashlib.sha256(b"\0" + data[at:at + 10]).digest())
                  for name, data in contents.items() for at in range(0, max(len(data), 1), 10))
    reader = blocks._Reader({"path": str(tmp_path), "blocksize": "10", "rangesize": "20"})
    dealt = reader.partitions()
    assert len(dealt) <= 512
    assert sorted(row for p in dealt for row in reader.read(p)) == want
    assert blocks.read_blocks(spark, str(tmp_path), 10, 20).rdd.getNumPartitions() == len(dealt)
    # a range that grows stays one that a task can read again
    monkeypatch.setattr(blocks, "RANGE", 50)
    dealt = reader.partitions()
    assert max(n for p in dealt for *_, n in p.ranges) == 5
    assert sorted(row for p in dealt for row in reader.read(p)) == want
