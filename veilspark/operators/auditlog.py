"""An audit log that shows tampering: a Merkle tree over the entries of each run, and a chain of heads
over the runs.

Entries are numbered within their run and hashed with all their fields; the nodes above them are kept
beside the log, a job per level. Checking computes the tree anew and walks down from the roots, so an
edited, deleted, inserted or swapped entry is not only noticed but named. The head of a run holds its
root and the head before it; keep the last one (`last_head`) where the log cannot be written, and a
log that was replaced as a whole shows too. An entry is proved part of a run by a few hashes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.writers import append_run, control_table, one_run, other_runs
from ..sources.blocks import FANOUT, changed_blocks, merkle, roots
from .govern import with_digest
from .skew import with_row_number

LOG, NODES, HEADS = "audit_logs", "audit_nodes", "audit_heads"
FIRST = "0" * 64  # the head before the first


def _leaves(entries: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(b"\0"), F.unhex("row_digest")), 256)
    return entries.select(F.col("run_id").alias("file_id"), (F.col("seq") - 1).cast("bigint").alias("block"),
                          F.lit(1).cast("bigint").alias("n_bytes"), F.unhex(digest).alias("hash"))


def _head(previous, root):
    return F.sha2(F.concat_ws("/", previous, root), 256)


def append(audit: DataFrame, out: str, run_id: str) -> DataFrame:
    """Add the audit rows of a run (`govern.audit_rows`) to the log below `out`; gives them back as they
    were written, with their number `seq`. A run that is repeated replaces its own entries and keeps
    its place in the chain."""
    spark = audit.sparkSession
    entries = with_row_number(audit, ["created_at", "id", "row_digest"], "seq").withColumn(
        "seq", F.col("seq").cast("bigint"))
    append_run(entries, f"{out}/{LOG}", run_id)
    written = one_run(f"{out}/{LOG}", run_id, entries)
    nodes = merkle(_leaves(written.withColumn("run_id", F.lit(run_id))))
    append_run(nodes.drop("file_id"), f"{out}/{NODES}", run_id)
    others = other_runs(spark, f"{out}/{HEADS}", run_id)
    place, previous = 0, FIRST
    if others is not None:
        mine = control_table(spark, f"{out}/{HEADS}").where(F.col("run_id") == run_id).first()
        before = others.where(F.col("place") < mine.place) if mine else others
        last = before.orderBy(F.desc("place")).first()
        place, previous = (mine.place if mine else last.place + 1), (last.head if last else FIRST)
    summary = roots(nodes).select("n_bytes", "fingerprint").first()
    root, n = (summary.fingerprint, summary.n_bytes) if summary else (FIRST, 0)
    head = spark.createDataFrame([(place, n, root, previous)], "place long, n_entries long, root string, previous string")
    append_run(head.withColumn("head", _head("previous", "root")), f"{out}/{HEADS}", run_id)
    return written


def last_head(spark: SparkSession, out: str) -> str:
    last = control_table(spark, f"{out}/{HEADS}").orderBy(F.desc("place")).first()
    return last.head if last else FIRST


def verify(spark: SparkSession, out: str, head: str | None = None) -> DataFrame:
    """(run_id, seq, change): what is not as it was written; empty for a sound log. `changed`, `added`
    and `removed` name entries; `root` and `chain` runs whose tree or head does not fit (no seq), and
    `head` a log that does not end in the given head."""
    entries = with_digest(control_table(spark, f"{out}/{LOG}").drop("row_digest"))
    kept = control_table(spark, f"{out}/{NODES}").withColumnRenamed("run_id", "file_id")
    heads = control_table(spark, f"{out}/{HEADS}")
    twice = entries.groupBy("run_id", "seq").count().where("count > 1").select(
        "run_id", "seq", F.lit("added").alias("change"))
    now = merkle(_leaves(entries.dropDuplicates(["run_id", "seq"])))
    differing = changed_blocks(kept, now).select(
        F.col("file_id").alias("run_id"), (F.col("block") + 1).alias("seq"), "change")
    found = roots(kept).select(F.col("file_id").alias("run_id"), F.col("fingerprint").alias("kept_root"))
    root = heads.join(found, "run_id", "full").where(
        ~F.coalesce("root", F.lit("")).eqNullSafe(F.coalesce("kept_root", F.when(F.col("n_entries") == 0, FIRST), F.lit("?"))))
    none = F.lit(None).cast("bigint").alias("seq")
    # one row per run: the heads in order
    in_order = W.orderBy("place")
    before = F.coalesce(F.lag("head").over(in_order), F.lit(FIRST))
    chained = heads.withColumns({"_before": before, "_place": F.row_number().over(in_order) - 1})
    broken = chained.where((F.col("previous") != F.col("_before")) | (F.col("place") != F.col("_place"))
                           | (F.col("head") != _head("previous", "root")))
    out_rows = differing.unionByName(twice).unionByName(
        root.select("run_id", none, F.lit("root").alias("change"))).unionByName(
        broken.select("run_id", none, F.lit("chain").alias("change")))
    if head is not None and last_head(spark, out) != head:
        ends = spark.createDataFrame([(None, None, "head")], "run_id string, seq bigint, change string")
        out_rows = out_rows.unionByName(ends)
    return out_rows


def proof(spark: SparkSession, out: str, run_id: str, seq: int) -> list[list[bytes]]:
    """For each level from the entry up, the hashes of the children of the node above it; at most
    FANOUT a level. With the entry's own hash among the first ones and the run's root, `proves`
    needs nothing else."""
    nodes = control_table(spark, f"{out}/{NODES}").where(F.col("run_id") == run_id)
    top = nodes.agg(F.max("level")).first()[0] or 0
    steps, node = [], seq - 1
    for level in range(top):
        rows = nodes.where((F.col("level") == level) & (F.expr(f"node div {FANOUT}") == node // FANOUT))
        steps.append([bytes(r.hash) for r in rows.orderBy("node").collect()])
        node //= FANOUT
    return steps


def proves(row_digest: str, steps: list[list[bytes]], root: str) -> bool:
    """Is the entry with this digest part of the run with this root?"""
    at = hashlib.sha256(b"\0" + bytes.fromhex(row_digest)).digest()
    for children in steps:
        if at not in children:
            return False
        at = hashlib.sha256(b"\1" + b"".join(children)).digest()
    return at.hex() == root
