"""One batch run: units of text in; report, vault, audit and masked text out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectConfig, secret_key
from ..operators import auditlog, govern, risk, vault
from ..operators.detect import add_detections, explode_detections
from ..operators.mask import MAPPING, mask_by_file, mask_texts, unit_tokens
from ..operators.skew import written as stage
from ..sinks.writers import append_run, append_vault, one_run, other_runs


@dataclass
class BatchResult:
    """Tables of a run. `tokens` holds plain values and lives in scratch space only."""

    detections: DataFrame
    report: DataFrame
    vault: DataFrame
    tokens: DataFrame
    masked: DataFrame


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows out evenly, by default over all cores: for a handful of small files that
    would otherwise keep few cores busy. A shuffle of all texts, so only on request."""
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class Protected:
    """What is known before anything is masked. `staged` and `tokens` hold plain values."""

    staged: DataFrame
    detections: DataFrame
    report: DataFrame
    vault: DataFrame
    tokens: DataFrame


def protect(
    units: DataFrame, out: str, run_id: str, cfg: DetectConfig, label: str | None,
    partitions: int | None, files: DataFrame | None = None,
) -> Protected:
    """The first half of a run: detect, write report and vault. `files` names files that may have
    no unit at all, for their reports."""
    spark = units.sparkSession
    key = secret_key(spark)
    given = units.select("file_id", "unit_id", "text", *([label] if label else []))
    given = spread(given, partitions) if partitions else given
    given = given.withColumn("text_hash", F.xxhash64("text"))
    staged = stage(add_detections(given, cfg, label=label), "detected")
    detections = explode_detections(staged, ["file_id", "unit_id", "text_hash"])

    files = staged.select("file_id").distinct() if files is None else files
    report = risk.reports(detections, files).withColumn("created_at", F.current_timestamp())
    append_run(report, f"{out}/compliance_reports", run_id)

    tokens = vault.assign_tokens(vault.distinct_values(detections), key)
    earlier = other_runs(spark, f"{out}/token_mappings", run_id)
    tokens = stage(vault.keep_earlier(tokens, earlier) if earlier else tokens, "tokens")
    entries = vault.encrypt_values(tokens, key).withColumn("created_at", F.current_timestamp())
    append_vault(entries, f"{out}/token_mappings", run_id)
    return Protected(
        staged, detections, one_run(f"{out}/compliance_reports", run_id, report),
        one_run(f"{out}/token_mappings", run_id, entries), tokens)


def run(
    units: DataFrame,
    out: str,
    run_id: str,
    cfg: DetectConfig = DetectConfig(),
    label: str | None = None,
    scope: str = "file",
    partitions: int | None = None,
    user_id: int | None = None,
) -> BatchResult:
    """Detect, score, tokenise and mask a table of units (file_id, unit_id, text).

    unit_id identifies a unit within its file. Detection is one narrow pass over the text,
    written once; the report and the vault then read only the detection column, and masking
    with scope "spans" shuffles the texts that have detections and no others.

    Texts are read by the input's own splits; `partitions` deals them out anew first. Units with
    a null id are reported under it and masked by type, without tokens. Values that earlier runs
    into `out` have tokenised keep their tokens.

    scope "file" replaces every occurrence of every value of the file, also where the context did
    not support it; "spans" replaces the detected positions only, and so leaves values in clear.

    With a `user_id` the run leaves two audit entries per file, mask and report (see `auditlog`).
    """
    found = protect(units, out, run_id, cfg, label, partitions)
    # units that share an id but not their text must not get each other's spans
    keys = ["file_id", "unit_id", "text_hash"]
    if scope == "file":
        masked = mask_by_file(found.staged, found.tokens, keys)
    else:
        spans = stage(unit_tokens(found.detections, found.tokens, keys), "spans")
        masked = mask_texts(found.staged, spans, keys)
    masked = masked.drop("detections", "text", "text_hash")
    append_run(masked, f"{out}/masked", run_id)
    back = one_run(f"{out}/masked", run_id, masked)
    if user_id is not None:
        auditlog.append(audit_of(found.report, user_id), out, run_id)
    return BatchResult(found.detections, found.report, found.vault, found.tokens, back)


def audit_of(report: DataFrame, user_id: int) -> DataFrame:
    """Audit rows of a run over units: for each file that it was masked, and what was reported."""
    events = report.select("*", F.explode(F.array(F.lit("mask"), F.lit("report"))).alias("action"))
    is_report = F.col("action") == "report"
    return govern.audit_rows(events.select(
        F.xxhash64(F.col("file_id").cast("string"), "action", "created_at").alias("id"),
        F.lit(user_id).cast("bigint").alias("user_id"), "action", F.lit("file").alias("resource_type"),
        F.xxhash64(F.col("file_id").cast("string")).alias("resource_id"), F.lit(None).cast("string").alias("ip_address"),
        "created_at", F.col("file_id").cast("string").alias("file_id"),
        F.when(is_report, F.col("total_pii_found")).alias("total_pii_found"),
        F.when(is_report, F.col("risk_score")).alias("risk_score"),
    ), ["file_id", "total_pii_found", "risk_score"])


def row_mapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Mapping (value, token) per unit from `unit_tokens`, for masking the cells of a row."""
    pairs = F.array_distinct(F.transform(
        "spans", lambda s: F.struct(s["value"].alias("value"), s["token"].alias("token"))
    ))
    return spans.select(*keys, pairs.cast(MAPPING).alias("mapping"))
