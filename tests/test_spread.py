"""Inputs of one split are dealt out before the work on them."""

import re

from checks import masking, names
from veilspark.operators.detect import add_detections
from veilspark.plans import batch


def test_two_runs_deal_out_their_texts(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(batch, "run", lambda units, out, run_id, **options: given.append(options))
    masking._two_runs(spark, sf_dir)
    assert [g["partitions"] for g in given] == [spark.sparkContext.defaultParallelism] * 2


def test_labelled_texts_are_built_by_all_cores(spark, sf_dir):
    assert names.labelled(spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_patterns_run_outside_of_whole_stage_code(spark):
    found = add_detections(spark.createDataFrame([(1, "phone 9876543210")], "i int, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    patterns = [line for line in plan.split("\n") if "Project" in line and "AS _m_AADHAAR" in line]
    assert patterns and not any(re.match(r"[\s:+|-]*\*\(", line) for line in patterns)
