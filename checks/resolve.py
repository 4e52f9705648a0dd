"""Overlap resolution and full detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.config import DetectConfig
from veilspark.operators.detect import add_candidates, detect_rows
from veilspark.operators.resolve import add_islands, by_priority, duplicate_spans, greedy, kept
from veilspark.plans.batch import spread
from veilspark.sources.tables import as_cells

from . import oracle as O
from .data import COLUMNS, NOTES, PEOPLE, ROWS, ctes, derive, units
from .registry import check

DOCS = "SELECT doc_id AS unit_id, source AS file_id, text FROM documents"


def plain(df, keys):
    """Detections as plain columns."""
    return df.select(
        *keys, F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "pii_type",
        F.round("confidence", 2).alias("confidence"), "method", "value",
    )


PLAIN = "s AS start_pos, e AS end_pos, pii_type, round(confidence, 2) AS confidence, method, value"


def _with_ctes(source, strict=False, ner=True):
    return {"t": source, **O.detection_ctes("t", "unit_id, file_id", strict, ner)}


# Overlapping spans on purpose: raw hits of all patterns, no exclusion and no context.
_RAW = " UNION ALL ".join(
    f"SELECT unit_id, s, e, value, {O.C.RANK[t]} AS rank, CAST({O.C.CONFIDENCE[t]} AS DOUBLE) AS confidence "
    f"FROM ({O.typed_spans('t', t, True, 'unit_id')})" for t in O.C.PATTERNS
)
_PATTERNS_ONLY = DetectConfig(strict=True, structured=False, recogniser="none")


def _raw_cands(spark, sf_dir):
    """Candidates with the context verdict lifted."""
    df = add_candidates(units(spark, sf_dir, NOTES), _PATTERNS_ONLY)
    lifted = F.transform("candidates", lambda c: c.withField("keep", F.lit(True)))
    return df.select("unit_id", lifted.alias("c"))


@check("o59_priority_order", ctes(t=NOTES, raw=_RAW) + """
SELECT unit_id, s AS start_pos, rank, value,
  row_number() OVER (PARTITION BY unit_id ORDER BY s - e, -confidence, rank, s) - 1 AS priority FROM raw""")
def o59(spark, sf_dir):
    df = _raw_cands(spark, sf_dir)
    rows = df.select("unit_id", F.posexplode_outer(F.expr(by_priority("c"))).alias("priority", "x"))
    return rows.where(F.col("x.start").isNotNull()).select(
        "unit_id", F.col("x.start").cast("bigint").alias("start_pos"), "x.rank", "x.value",
        F.col("priority").cast("bigint").alias("priority"),
    )


@check("o60_greedy_choice", ctes(
    t=NOTES, raw=_RAW,
    l="SELECT unit_id, list({'s': s, 'e': e, 'rank': rank, 'value': value} ORDER BY s - e, -confidence, rank, s) AS l FROM raw GROUP BY unit_id",
    r="SELECT unit_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, "
      "lambda d: greatest(d.s, x[1].s) < least(d.e, x[1].e))) > 0 THEN acc ELSE list_concat(acc, x) END) AS l FROM l",
) + "SELECT unit_id, d.s AS start_pos, d.e AS end_pos, d.rank AS rank, d.value AS value FROM (SELECT unit_id, unnest(l) AS d FROM r)")
def o60(spark, sf_dir):
    df = _raw_cands(spark, sf_dir)
    rows = df.select("unit_id", F.explode_outer(F.expr(greedy(kept("c")))).alias("x"))
    return rows.where(F.col("x.start").isNotNull()).select(
        "unit_id", F.col("x.start").cast("bigint").alias("start_pos"),
        F.col("x.end").cast("bigint").alias("end_pos"), "x.rank", "x.value",
    )


@check("o61_islands", ctes(t=NOTES, raw=_RAW, flagged="""
SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY unit_id ORDER BY s, e, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
  THEN 1 ELSE 0 END AS opens FROM raw""") + """
SELECT unit_id, s AS start_pos, e AS end_pos, rank,
  CAST(sum(opens) OVER (PARTITION BY unit_id ORDER BY s, e, rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM flagged""")
def o61(spark, sf_dir):
    rows = _raw_cands(spark, sf_dir).select("unit_id", F.explode_outer("c").alias("x"))
    spans = rows.where(F.col("x.start").isNotNull()).select("unit_id", "x.start", "x.end", "x.rank")
    return add_islands(spans, ["unit_id"]).select(
        "unit_id", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "rank", "island",
    )


def _detect_check(name, source, strict, ner=True):
    cfg = DetectConfig(strict=strict, recogniser="cue" if ner else "none")

    @check(name, ctes(**_with_ctes(source, strict, ner)) + f"SELECT unit_id, file_id, {PLAIN} FROM det")
    def query(spark, sf_dir):
        found = detect_rows(units(spark, sf_dir, source), ["unit_id", "file_id"], cfg)
        return plain(found, ["unit_id", "file_id"])


_detect_check("o62_detect_notes_strict", NOTES, True)
_detect_check("o62_detect_notes", NOTES, False)
_detect_check("o62_detect_rows", ROWS, False)
_detect_check("o62_detect_rows_strict", ROWS, True)
_detect_check("o62_detect_documents", DOCS, False)


# Column-aware form: every cell with its column name as label.
_CELLS = " UNION ALL ".join(
    f"SELECT c_custkey AS unit_id, '{c}' AS label, {c} AS text FROM ({PEOPLE}) p" for c in COLUMNS
)


@check("o62_detect_cells", ctes(p=PEOPLE) + " UNION ALL ".join(
    f"SELECT c_custkey AS unit_id, '{c}' AS label, CAST(0 AS BIGINT) AS start_pos, length({c}) AS end_pos, '{t}' AS pii_type, {c} AS value FROM p"
    for c, t in zip(COLUMNS, ["PERSON_NAME", "PHONE_NUMBER", "EMAIL_ADDRESS", "AADHAAR", "PAN", "ADDRESS",
                              "BANK_ACCOUNT", "IFSC", "UPI_ID", "VOTER_ID", "PASSPORT"])))
def o62_cells(spark, sf_dir):
    people = derive(spark, sf_dir, PEOPLE).withColumnRenamed("c_custkey", "unit_id")
    cells = spread(as_cells(people, COLUMNS, ["unit_id"]))
    found = plain(detect_rows(cells, ["unit_id", "label"], label="label"), ["unit_id", "label"])
    return found.drop("confidence", "method")


# Rendered rows without a label beside texts whose column says nothing: labels in the text decide.
@check("o62_detect_mixed_labels", ctes(**_with_ctes(ROWS)) + f"SELECT unit_id, file_id, {PLAIN} FROM det")
def o62_mixed(spark, sf_dir):
    rows = units(spark, sf_dir, ROWS).withColumn(
        "label", F.expr("CASE unit_id % 3 WHEN 0 THEN 'remarks' WHEN 1 THEN '' END"))
    return plain(detect_rows(rows, ["unit_id", "file_id"], label="label"), ["unit_id", "file_id"])


@check("o62_min_confidence", ctes(**_with_ctes(NOTES)) + """
SELECT unit_id, s AS start_pos, pii_type FROM det WHERE confidence >= 0.9""")
def o62_min(spark, sf_dir):
    found = detect_rows(units(spark, sf_dir, NOTES), ["unit_id"], DetectConfig(min_confidence=0.9))
    return found.select("unit_id", F.col("start").cast("bigint").alias("start_pos"), "pii_type")


@check("o63_duplicate_spans_of_raw_hits", ctes(t=NOTES, raw=_RAW) + """
SELECT unit_id, s AS start_pos, e AS end_pos, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1""")
def o63_raw(spark, sf_dir):
    rows = _raw_cands(spark, sf_dir).select("unit_id", F.explode_outer("c").alias("x"))
    spans = rows.where(F.col("x.start").isNotNull()).select(
        "unit_id", F.col("x.start").cast("bigint").alias("start"), F.col("x.end").cast("bigint").alias("end"))
    return duplicate_spans(spans, ["unit_id"]).withColumnsRenamed(
        {"start": "start_pos", "end": "end_pos"})


@check("o63_duplicate_spans", ctes(**_with_ctes(NOTES)) + """
SELECT count(*) AS duplicates FROM (SELECT unit_id, s, e FROM det GROUP BY ALL HAVING count(*) > 1)""")
def o63(spark, sf_dir):
    found = detect_rows(units(spark, sf_dir, NOTES), ["unit_id"])
    return duplicate_spans(found, ["unit_id"]).agg(F.count("*").alias("duplicates"))

