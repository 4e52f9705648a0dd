"""Risk, reports and corpus figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import govern, risk
from veilspark.operators.detect import detect_rows

from . import oracle as O
from .data import AUDIT, FILES, NOTES, PEOPLE, ctes, derive, units
from .registry import check

# 300 files of different make-up; file 0 also holds the last third of all rows.
UNITS = f"""
SELECT unit_id, CASE WHEN unit_id % 3 = 2 AND unit_id % 12 < 6 THEN 0 ELSE unit_id % 300 END AS file_id, text
FROM ({NOTES}) n"""
# Units whose file number is divisible by 12 say nothing.
KEYS = "unit_id, file_id"
_DET = {"t": UNITS, **O.detection_ctes("t", KEYS, False)}


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_COUNTS = {
    **_DET,
    "c": f"""SELECT file_id, count(*) AS total, count(DISTINCT pii_type) AS types,
  count(*) FILTER (WHERE pii_type IN {in_list(O.C.HIGH_RISK)}) AS high,
  count(*) FILTER (WHERE pii_type IN {in_list(O.C.MEDIUM_RISK)}) AS medium,
  count(*) FILTER (WHERE pii_type IN {in_list(O.C.LOW_RISK)}) AS low
FROM det GROUP BY file_id""",
    "scored": """SELECT *, CASE WHEN high > 0 THEN 8.0::DOUBLE WHEN medium > 0 THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END AS base,
  least(types / 8.0::DOUBLE, 1.0::DOUBLE) AS diversity, least(log10(total + 1) / 3.0::DOUBLE, 1.0::DOUBLE) AS volume FROM c""",
    "score": "SELECT *, least(round_even(base + diversity + volume, 1), 10.0::DOUBLE) AS risk_score FROM scored",
}


def _detected(spark, sf_dir):
    return detect_rows(units(spark, sf_dir, UNITS), ["file_id", "unit_id"])


def _counts(spark, sf_dir):
    return risk.class_counts(risk.type_counts(_detected(spark, sf_dir)))


@check("o64_total_per_file", ctes(**_COUNTS) + "SELECT file_id, total FROM c")
def o64(spark, sf_dir):
    return _counts(spark, sf_dir).select("file_id", F.col("total_pii_found").alias("total"))


@check("o65_type_histogram", ctes(**_DET) + "SELECT file_id, pii_type, count(*) AS n FROM det GROUP BY ALL")
def o65(spark, sf_dir):
    return risk.type_counts(_detected(spark, sf_dir))


@check("o66_distinct_types", ctes(**_COUNTS) + "SELECT file_id, types FROM c")
def o66(spark, sf_dir):
    return _counts(spark, sf_dir).select("file_id", F.col("distinct_types").alias("types"))


@check("o67_class_counts", ctes(**_COUNTS) + "SELECT file_id, high, medium, low FROM c")
def o67(spark, sf_dir):
    return _counts(spark, sf_dir).select("file_id", "high", "medium", "low")


@check("o68_severity_base", ctes(**_COUNTS) + "SELECT file_id, base FROM scored")
def o68(spark, sf_dir):
    base = risk.severity_base(F.col("high"), F.col("medium"))
    return _counts(spark, sf_dir).select("file_id", base.alias("base"))


@check("o69_diversity_bonus", ctes(**_COUNTS) + "SELECT file_id, diversity FROM scored")
def o69(spark, sf_dir):
    return _counts(spark, sf_dir).select(
        "file_id", risk.diversity_bonus(F.col("distinct_types")).alias("diversity"))


@check("o70_volume_bonus", ctes(**_COUNTS) + "SELECT file_id, round(volume, 6) AS volume FROM scored")
def o70(spark, sf_dir):
    volume = risk.volume_bonus(F.col("total_pii_found"))
    return _counts(spark, sf_dir).select("file_id", F.round(volume, 6).alias("volume"))


def _scored(spark, sf_dir):
    score = risk.risk_score(*[F.col(c) for c in ("total_pii_found", "distinct_types", "high", "medium")])
    return _counts(spark, sf_dir).withColumn("risk_score", score)


_STATUS = """CASE WHEN total = 0 THEN 'compliant' WHEN risk_score > 9 THEN 'critical' WHEN risk_score > 7 THEN 'high_risk'
  WHEN risk_score > 4 THEN 'medium_risk' ELSE 'low_risk' END"""


@check("o71_risk_score", ctes(**_COUNTS) + "SELECT file_id, risk_score FROM score")
def o71(spark, sf_dir):
    return _scored(spark, sf_dir).select("file_id", "risk_score")


@check("o72_compliance_status", ctes(**_COUNTS) + f"SELECT file_id, {_STATUS} AS status FROM score")
def o72(spark, sf_dir):
    status = risk.compliance_status(F.col("risk_score"), F.col("total_pii_found"))
    return _scored(spark, sf_dir).select("file_id", status.alias("status"))


_REPORT = {
    **_COUNTS,
    "h": "SELECT file_id, string_agg(concat('\"', pii_type, '\":', CAST(n AS STRING)), ',' ORDER BY pii_type) AS b "
         "FROM (SELECT file_id, pii_type, count(*) AS n FROM det GROUP BY ALL) GROUP BY file_id",
    "f": "SELECT DISTINCT file_id FROM t",
    "full_score": "SELECT f.file_id, coalesce(total, 0) AS total, coalesce(risk_score, 0.0::DOUBLE) AS risk_score, "
                  "concat('{', coalesce(b, ''), '}') AS pii_breakdown FROM f LEFT JOIN score USING (file_id) LEFT JOIN h USING (file_id)",
}


def _report(spark, sf_dir):
    return risk.reports(_detected(spark, sf_dir), derive(spark, sf_dir, UNITS))


@check("o73_report", ctes(**_REPORT) + f"""
SELECT file_id, total AS total_pii_found, pii_breakdown, risk_score, {_STATUS} AS compliance_status FROM full_score""")
def o73(spark, sf_dir):
    return _report(spark, sf_dir).withColumn("pii_breakdown", risk.breakdown_json(F.col("pii_breakdown")))


_RUNS = """
SELECT o_orderkey AS id, o_custkey AS file_id, CAST(o_orderkey % 50 AS BIGINT) AS total_pii_found,
  CAST(o_orderkey % 101 AS DOUBLE) / 10 AS risk_score, o_orderdate AS created_at FROM orders"""


@check("o73_latest_report", ctes(r=_RUNS) + """
SELECT file_id, id, total_pii_found, risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS k FROM r) WHERE k = 1""")
def o73_latest(spark, sf_dir):
    return risk.latest_reports(derive(spark, sf_dir, _RUNS)).drop("created_at")


@check("o74_display_band", ctes(**_REPORT) + """
SELECT file_id, CASE WHEN risk_score > 9 THEN 'Critical' WHEN risk_score > 7 THEN 'High' WHEN risk_score > 4 THEN 'Medium'
  WHEN risk_score > 0 THEN 'Low' ELSE 'No Risk' END AS band FROM full_score""")
def o74(spark, sf_dir):
    return _report(spark, sf_dir).select("file_id", risk.display_band(F.col("risk_score")).alias("band"))


@check("o75_breakdown_listing", ctes(**_DET) + "SELECT file_id, pii_type, count(*) AS n FROM det GROUP BY ALL")
def o75(spark, sf_dir):
    return risk.list_breakdown(_report(spark, sf_dir))


@check("o76_corpus_stats", ctes(f=FILES, r=_RUNS) + """
SELECT (SELECT count(*) FROM f) AS total_files, (SELECT count(*) FROM f WHERE status = 'completed') AS files_processed,
  CAST(coalesce(sum(total_pii_found), 0) AS BIGINT) AS total_pii_found,
  coalesce(round_even(avg(risk_score), 2), 0.0) AS avg_risk_score FROM r""")
def o76(spark, sf_dir):
    return risk.corpus_stats(derive(spark, sf_dir, FILES), derive(spark, sf_dir, _RUNS))


@check("o76_corpus_stats_without_reports", ctes(f=FILES) + """
SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'completed') AS files_processed,
  CAST(0 AS BIGINT) AS total_pii_found, CAST(0 AS DOUBLE) AS avg_risk_score FROM f""")
def o76_empty(spark, sf_dir):
    return risk.corpus_stats(derive(spark, sf_dir, FILES), derive(spark, sf_dir, _RUNS).where("id < 0"))


@check("o77_vault_stats", ctes(p=PEOPLE) + """
SELECT CAST(count(*) AS BIGINT) AS tokens, count(DISTINCT pii_type) AS types FROM (
  SELECT DISTINCT mobile AS v, 'PHONE_NUMBER' AS pii_type FROM p UNION ALL SELECT DISTINCT full_name, 'PERSON_NAME' FROM p)""")
def o77(spark, sf_dir):
    people = derive(spark, sf_dir, PEOPLE)
    vault = people.selectExpr("mobile AS v", "'PHONE_NUMBER' AS pii_type").distinct().unionByName(
        people.selectExpr("full_name AS v", "'PERSON_NAME' AS pii_type").distinct())
    return risk.vault_stats(vault)


@check("o78_audit_count", ctes(a=AUDIT) + "SELECT count(*) AS events FROM a")
def o78(spark, sf_dir):
    return govern.audit_count(derive(spark, sf_dir, AUDIT))
