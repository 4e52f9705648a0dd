"""Risk score, compliance status and report per file, and figures for the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def type_counts(detections: DataFrame, file: str = "file_id") -> DataFrame:
    """Detections per file and type. Combined before the shuffle, at most eleven rows per
    file after it, so one huge file is no hot key for anything that follows."""
    return detections.groupBy(file, "pii_type").agg(F.count("*").alias("n"))


def _class_sums() -> list[Column]:
    def of(types):
        return F.coalesce(F.sum(F.when(F.col("pii_type").isin(types), F.col("n"))), F.lit(0))

    return [
        F.sum("n").alias("total_pii_found"),
        F.count("*").alias("distinct_types"),
        of(C.HIGH_RISK).alias("high"),
        of(C.MEDIUM_RISK).alias("medium"),
        of(C.LOW_RISK).alias("low"),
    ]


def class_counts(counts: DataFrame, file: str = "file_id") -> DataFrame:
    """Total, distinct types and detections per risk class, from `type_counts`."""
    return counts.groupBy(file).agg(*_class_sums())


def severity_base(high: Column, medium: Column) -> Column:
    return F.when(high > 0, 8.0).when(medium > 0, 5.0).otherwise(2.0)


def diversity_bonus(types: Column) -> Column:
    return F.least(types / 8.0, F.lit(1.0))


def volume_bonus(total: Column) -> Column:
    return F.least(F.log10(total + 1) / 3.0, F.lit(1.0))


def risk_score(total: Column, types: Column, high: Column, medium: Column) -> Column:
    """Severity, diversity and volume, rounded half-even to one place, at most 10."""
    raw = severity_base(high, medium) + diversity_bonus(types) + volume_bonus(total)
    return F.when(total > 0, F.least(F.bround(raw, 1), F.lit(10.0))).otherwise(0.0)


def compliance_status(score: Column, total: Column) -> Column:
    return (
        F.when(total == 0, "compliant")
        .when(score > 9, "critical")
        .when(score > 7, "high_risk")
        .when(score > 4, "medium_risk")
        .otherwise("low_risk")
    )


def display_band(score: Column) -> Column:
    return (
        F.when(score > 9, "Critical")
        .when(score > 7, "High")
        .when(score > 4, "Medium")
        .when(score > 0, "Low")
        .otherwise("No Risk")
    )


def reports(detections: DataFrame, files: DataFrame | None = None, file: str = "file_id") -> DataFrame:
    """One report row per file. With `files`, files without any detection get one too."""
    return reports_from_counts(type_counts(detections, file), files, file)


def merge_reports(parts: DataFrame, file: str = "file_id") -> DataFrame:
    """One report per file out of the reports of its runs or batches: detections of each type
    are added up and scored as a whole."""
    rows = parts.select(file, F.explode("pii_breakdown").alias("pii_type", "n"))
    counts = rows.groupBy(file, "pii_type").agg(F.sum("n").alias("n"))
    return reports_from_counts(counts, parts, file)


def reports_from_counts(
    counts: DataFrame, files: DataFrame | None = None, file: str = "file_id"
) -> DataFrame:
    """Reports from the number of detections per file and type."""
    per_file = counts.groupBy(file).agg(
        *_class_sums(),
        # at most eleven entries
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("pii_type", "n"))))
        .alias("pii_breakdown"),
    )
    if files is not None:
        per_file = files.select(file).distinct().join(per_file, file, "left")
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("total_pii_found", zero)
    score = risk_score(total, F.coalesce("distinct_types", zero), F.coalesce("high", zero),
                       F.coalesce("medium", zero))
    return (
        per_file.select(
            file,
            total.alias("total_pii_found"),
            F.coalesce("pii_breakdown", F.create_map().cast("map<string,bigint>"))
            .alias("pii_breakdown"),
            score.alias("risk_score"),
        )
        .withColumn("compliance_status",
                    compliance_status(F.col("risk_score"), F.col("total_pii_found")))
    )


def breakdown_json(breakdown: Column) -> Column:
    return F.to_json(breakdown)


def parse_breakdown(text: Column) -> Column:
    """The stored breakdown as a map; an empty one when none is stored."""
    return F.coalesce(
        F.from_json(text, "map<string,bigint>"), F.create_map().cast("map<string,bigint>")
    )


def list_breakdown(reports_: DataFrame, file: str = "file_id") -> DataFrame:
    return reports_.select(file, F.explode("pii_breakdown").alias("pii_type", "n"))


def latest_reports(reports_: DataFrame, file: str = "file_id") -> DataFrame:
    """The newest report of each file: one maximum per file, combined before the shuffle."""
    cols = [c for c in reports_.columns if c not in (file, "created_at", "id")]
    newest = F.max_by(F.struct("id", "created_at", *cols), F.struct("created_at", "id"))
    return reports_.groupBy(file).agg(newest.alias("r")).select(file, "r.*")


def corpus_stats(files: DataFrame, reports_: DataFrame) -> DataFrame:
    """Files, completed files, personal data found and mean risk, as one row."""
    found = reports_.agg(F.coalesce(F.sum("total_pii_found"), F.lit(0)))
    mean = reports_.agg(F.coalesce(F.bround(F.avg("risk_score"), 2), F.lit(0.0)))
    return files.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "completed").alias("files_processed"),
    ).select(
        "*", found.scalar().alias("total_pii_found"), mean.scalar().alias("avg_risk_score")
    )


def vault_stats(vault: DataFrame) -> DataFrame:
    """Tokens and distinct types; types are counted before they are made distinct."""
    per_type = vault.groupBy("pii_type").agg(F.count("*").alias("n"))
    return per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")
    )
