"""Pattern spans, exclusion, blank guard, and the recogniser."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import constants as C
from veilspark.config import DetectConfig
from veilspark.functions.spans import blocks, searchable
from veilspark.functions.text import has_text
from veilspark.operators import patterns, recogniser
from veilspark.operators.detect import add_candidates
from veilspark.operators.resolve import exclude, without_overlaps

from . import oracle as O
from .data import CORPUS, NOTES, PEOPLE, ctes, derive, units
from .registry import check

KEYS = "src, unit_id"
BLOCKS = blocks("text")
CORPUS_KEYS = ["src", "unit_id"]


def span_rows(df, keys, spans):
    """Explode an array of spans to plain columns."""
    rows = df.select(*keys, F.explode_outer(F.expr(spans)).alias("x")).where(F.col("x.start").isNotNull())
    return rows.select(
        *keys, "x.value", F.col("x.start").cast("bigint").alias("start_pos"),
        F.col("x.end").cast("bigint").alias("end_pos"),
    )


def pattern_rows(df, pii_type, keys, strict=True):
    clean = df.withColumn("t", F.expr(searchable("text")))
    found = clean.withColumn("m", F.expr(patterns.find_pieces("t", pii_type, strict)))
    return span_rows(found, keys, patterns.find_spans(BLOCKS, "m", pii_type, strict))


def _span_check(number: int, pii_type: str, strict: bool = True, suffix: str = ""):
    sql = ctes(corpus=CORPUS) + (
        f"SELECT src, unit_id, value, s AS start_pos, e AS end_pos "
        f"FROM ({O.typed_spans('corpus', pii_type, strict, KEYS)})"
    )

    @check(f"o{number}_{pii_type.lower()}_spans{suffix}", sql)
    def query(spark, sf_dir):
        return pattern_rows(units(spark, sf_dir, CORPUS), pii_type, CORPUS_KEYS, strict)


for _n, _t in enumerate(C.PATTERNS, 25):
    _span_check(_n, _t)
_span_check(25, "AADHAAR", False, "_with_country_code_rule")
_span_check(27, "PHONE_NUMBER", False, "_with_country_code")


_RAW = " UNION ALL ".join(
    f"SELECT unit_id, s, e, value, {C.RANK[t]} AS rank FROM ({O.typed_spans('notes', t, True, 'unit_id')})"
    for t in C.PATTERNS
)
_EXCLUDED = {
    "notes": NOTES,
    "raw": _RAW,
    "x0": "SELECT * FROM raw WHERE rank <= 5",
    **{
        f"x{i + 1}": f"SELECT * FROM x{i} UNION ALL SELECT * FROM raw a WHERE rank = {r} AND NOT EXISTS "
        f"(SELECT 1 FROM x{i} b WHERE a.unit_id = b.unit_id AND greatest(a.s, b.s) < least(a.e, b.e))"
        for i, r in enumerate((6, 7, 8))
    },
}


@check("o34_overlap_exclusion", ctes(**_EXCLUDED) + """
SELECT unit_id, s AS start_pos, e AS end_pos, rank, value FROM x3
UNION ALL SELECT unit_id, s, e, rank, value FROM raw WHERE rank = 9""")
def o34(spark, sf_dir):
    cfg = DetectConfig(strict=True, structured=False, recogniser="none")
    cands = add_candidates(units(spark, sf_dir, NOTES), cfg)
    rows = cands.select("unit_id", F.explode_outer(F.expr(exclude("candidates"))).alias("x"))
    return rows.where(F.col("x.start").isNotNull()).select(
        "unit_id", F.col("x.start").cast("bigint").alias("start_pos"),
        F.col("x.end").cast("bigint").alias("end_pos"), "x.rank", "x.value",
    )


@check("o34_overlap_anti_join", ctes(notes=NOTES) + f"""
SELECT unit_id, s AS start_pos, e AS end_pos, value
FROM ({O.typed_spans('notes', 'BANK_ACCOUNT', True, 'unit_id')}) a
WHERE NOT EXISTS (SELECT 1 FROM ({O.typed_spans('notes', 'PHONE_NUMBER', True, 'unit_id')}) b
  WHERE a.unit_id = b.unit_id AND greatest(a.s, b.s) < least(a.e, b.e))""")
def o34_join(spark, sf_dir):
    notes = derive(spark, sf_dir, NOTES)
    names = {"start_pos": "start", "end_pos": "end"}
    bank = pattern_rows(notes, "BANK_ACCOUNT", ["unit_id"])
    phone = pattern_rows(notes, "PHONE_NUMBER", ["unit_id"])
    left = without_overlaps(
        bank.withColumnsRenamed(names),
        phone.withColumnsRenamed(names), ["unit_id"],
    )
    return left.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


_BLANKS = f"""
SELECT unit_id, CASE unit_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  ', chr(10), chr(9), ' ') WHEN 2 THEN NULL ELSE text END AS text
FROM ({NOTES}) n"""


@check("o35_blank_guard", ctes(t=_BLANKS) + r"""
SELECT unit_id, text FROM t WHERE text IS NOT NULL AND regexp_matches(text, '\S')""")
def o35(spark, sf_dir):
    return derive(spark, sf_dir, _BLANKS).where(has_text("text"))


def _cue_sql(source: str, pattern: str, person: bool) -> str:
    return (f"SELECT unit_id, value, s AS start_pos, e AS end_pos FROM ({O.spans(source, pattern, 'unit_id')}) "
            f"WHERE {O.acceptable('value', person)}")


@check("o36_person_recogniser", ctes(notes=NOTES) + _cue_sql("notes", O.PERSON, True))
def o36_person(spark, sf_dir):
    df = derive(spark, sf_dir, NOTES).withColumn("m", F.expr(recogniser.find_people("text")))
    return span_rows(df, ["unit_id"], recogniser.cue_spans("m", "PERSON_NAME"))


@check("o36_place_recogniser", ctes(notes=NOTES) + _cue_sql("notes", O.PLACE, False))
def o36_place(spark, sf_dir):
    df = derive(spark, sf_dir, NOTES).withColumn("m", F.expr(recogniser.find_places("text")))
    return span_rows(df, ["unit_id"], recogniser.cue_spans("m", "ADDRESS"))


@check("o36_model_hook", ctes(notes=NOTES) + f"""
SELECT unit_id, value, s AS start_pos, e AS end_pos
FROM ({O.spans('notes', '[A-Z][a-z]+ [A-Z][a-z]+', 'unit_id')}) WHERE {O.acceptable('value', True)}""")
def o36_hook(spark, sf_dir):
    def upper_runs(text):  # nested, so that it travels to the executors by value
        import re

        found = re.finditer(r"[A-Z][a-z]+ [A-Z][a-z]+", text)
        return [(m.start(), m.end(), "PERSON") for m in found]

    df = derive(spark, sf_dir, NOTES).withColumn(
        "e", recogniser.entity_column(F.col("text"), upper_runs)
    )
    return span_rows(df, ["unit_id"], recogniser.model_spans(BLOCKS, "e", "PERSON_NAME"))


# Values of many shapes: geo terms, dotted paths, short and odd names.
_SHAPES = f"""
SELECT c_custkey AS unit_id, CASE c_custkey % 9 WHEN 0 THEN full_name WHEN 1 THEN 'New Delhi' WHEN 2 THEN 'location.street.number'
  WHEN 3 THEN concat('Al', CAST(c_custkey AS STRING)) WHEN 4 THEN 'Bob' WHEN 5 THEN 'J. R. Rao-Iyer' WHEN 6 THEN 'Iyer'
  WHEN 7 THEN 'INDIA' ELSE address END AS value
FROM ({PEOPLE}) p"""


def _shape_check(name, sql_rule, rule):
    @check(name, ctes(t=_SHAPES) + f"SELECT unit_id, value FROM t WHERE {sql_rule}")
    def query(spark, sf_dir):
        return derive(spark, sf_dir, _SHAPES).where(rule("value"))


_shape_check(
    "o37_geo_exclusion",
    f"lower(trim(value)) NOT IN ({', '.join(repr(g) for g in C.GEO_EXCLUSIONS)})",
    lambda v: "NOT " + recogniser.is_excluded(v),
)
_shape_check(
    "o38_dotted_path_filter",
    r"NOT (contains(value, '.') AND regexp_full_match(value, '[\pL\pN]+(\.[\pL\pN]+)*'))",
    lambda v: "NOT " + recogniser.is_dotted_path(v),
)
_shape_check(
    "o39_person_shape",
    r"length(value) >= 2 AND regexp_full_match(replace(replace(replace(value, ' ', ''), '.', ''), '-', ''), '\pL+') "
    "AND (contains(value, ' ') OR length(value) >= 4)",
    recogniser.is_person_shape,
)
_shape_check("o40_address_length", "length(value) >= 5", recogniser.is_place_shape)


@check("o41_chunks", """
SELECT doc_id, CAST(o AS BIGINT) AS chunk_offset, substr(text, o + 1, 1000) AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS o FROM documents)""")
def o41(spark, sf_dir):
    docs = derive(spark, sf_dir, "SELECT doc_id, text FROM documents")
    return recogniser.split_chunks(docs, chunk=1000).withColumn(
        "chunk_offset", F.col("chunk_offset").cast("bigint")
    )

