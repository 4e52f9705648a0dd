"""What is changed in an audit log is found and named."""

import pytest
from pyspark.sql import functions as F

from veilspark.config import DetectConfig
from veilspark.operators import auditlog, govern
from veilspark.plans import batch
from veilspark.sinks.writers import append_run, control_table, one_run


def events(spark, start, n):
    return govern.audit_rows(spark.range(start, start + n).select(
        "id", (F.col("id") % 5).alias("user_id"), F.lit("mask").alias("action"), F.lit("file").alias("resource_type"),
        F.col("id").alias("resource_id"), F.lit(None).cast("string").alias("ip_address"),
        F.timestamp_seconds(F.col("id") * 7).alias("created_at")), ["resource_id"])


@pytest.fixture
def log(spark, tmp_path):
    out = str(tmp_path)
    for run_id, start, n in (("1", 0, 200), ("01", 1000, 3), ("none", 0, 0), ("2026-01-05", 5000, 70)):
        auditlog.append(events(spark, start, n), out, run_id)
    return out


def found(spark, out, head=None):
    return sorted((r.run_id or "", r.seq or 0, r.change) for r in auditlog.verify(spark, out, head).collect())


def rewrite(spark, out, run_id, change):
    """What someone with access to the files would do to the entries of a run."""
    entries = one_run(f"{out}/audit_logs", run_id, control_table(spark, f"{out}/audit_logs").drop("run_id"))
    rows = change(entries).collect()
    append_run(spark.createDataFrame(rows, entries.schema), f"{out}/audit_logs", run_id)


def test_a_sound_log(spark, log):
    assert found(spark, log) == [] == found(spark, log, auditlog.last_head(spark, log))
    auditlog.append(events(spark, 1000, 3), log, "01")  # a repeated run
    assert found(spark, log) == []
    assert control_table(spark, f"{log}/audit_logs").count() == 273


def test_edits_deletions_and_swaps_are_named(spark, log):
    rewrite(spark, log, "1", lambda e: govern.with_digest(e.drop("row_digest").withColumn(
        "user_id", F.when(F.col("seq") == 77, 99).otherwise(F.col("user_id")))).select(*e.columns))
    assert found(spark, log) == [("1", 77, "changed")]
    rewrite(spark, log, "01", lambda e: e.where("seq != 2"))
    rewrite(spark, log, "2026-01-05", lambda e: e.withColumn("seq", F.expr("CASE seq WHEN 10 THEN 60 WHEN 60 THEN 10 ELSE seq END")))
    assert found(spark, log) == [
        ("01", 2, "removed"), ("1", 77, "changed"), ("2026-01-05", 10, "changed"), ("2026-01-05", 60, "changed")]
    rewrite(spark, log, "01", lambda e: e.unionByName(e.where("seq = 1").withColumn("seq", F.lit(4).cast("bigint"))))
    assert ("01", 4, "added") in found(spark, log)


def test_replaced_runs_show_in_the_heads(spark, log):
    head = auditlog.last_head(spark, log)
    rewrite(spark, log, "01", lambda e: e.where("seq < 3"))
    entries = control_table(spark, f"{log}/audit_logs").where("run_id = '01'")
    nodes = auditlog.merkle(auditlog._leaves(entries))
    append_run(nodes.drop("file_id"), f"{log}/audit_nodes", "01")  # entries and tree fit again
    assert found(spark, log) == [("01", 0, "root")]
    auditlog.append(entries.drop("run_id", "seq"), log, "01")  # and the head, but not those after it
    assert found(spark, log) == [("none", 0, "chain")]
    assert found(spark, log, head) == [("none", 0, "chain")]
    assert found(spark, log, "another head")[0] == ("", 0, "head")


def test_proofs(spark, log):
    entries = control_table(spark, f"{log}/audit_logs").where("run_id = '1' AND seq IN (1, 64, 65, 200)").collect()
    root = control_table(spark, f"{log}/audit_heads").where("run_id = '1'").first().root
    for e in entries:
        steps = auditlog.proof(spark, log, "1", e.seq)
        assert len(steps) == 2 and all(len(s) <= 64 for s in steps)
        assert auditlog.proves(e.row_digest, steps, root)
        assert not auditlog.proves("00" * 32, steps, root) and not auditlog.proves(e.row_digest, steps, "00" * 32)


def test_a_run_over_units_leaves_entries(spark, tmp_path):
    units = spark.createDataFrame([("f", 1, "mobile: 9876543210"), ("g", 1, "none")], "file_id string, unit_id int, text string")
    batch.run(units, str(tmp_path), "r", DetectConfig(recogniser="none"), user_id=3)
    rows = control_table(spark, f"{tmp_path}/audit_logs").select("action", "user_id", "details").collect()
    assert sorted((r.action, r.user_id) for r in rows) == [("mask", 3)] * 2 + [("report", 3)] * 2
    assert found(spark, str(tmp_path)) == [] and any('"total_pii_found":1' in r.details for r in rows)
