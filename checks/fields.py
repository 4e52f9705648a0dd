"""Label-value pairs, field rules and the context filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import constants as C
from veilspark.config import DetectConfig
from veilspark.functions.spans import blocks
from veilspark.functions.text import label_parts, strip
from veilspark.operators import context, fields
from veilspark.operators.detect import add_candidates

from . import oracle as O
from .data import LABELLED, NOTES, ROWS, ctes, derive, units
from .registry import check

_TEXTS = f"SELECT unit_id, file_id, text FROM ({NOTES}) n UNION ALL SELECT unit_id + 1000000000, file_id, text FROM ({ROWS}) r"


@check("o42_label_value_pairs", ctes(t=_TEXTS) + f"""
SELECT unit_id, label, value, s AS start_pos, e AS end_pos FROM ({O.pairs('t', 'unit_id')})""")
def o42(spark, sf_dir):
    df = derive(spark, sf_dir, _TEXTS)
    df = df.withColumn("m", F.expr(fields.find_pairs("text", only_relevant=False)))
    rows = df.select("unit_id", F.explode_outer(F.expr(fields.pair_spans(blocks("text"), "m", only_relevant=False))).alias("x"))
    return rows.where(F.col("x.start").isNotNull()).select(
        "unit_id", "x.label", "x.value", F.col("x.start").cast("bigint").alias("start_pos"),
        F.col("x.end").cast("bigint").alias("end_pos"),
    )


def _labelled(name, columns, sql_columns, sql_where="true", where=None):
    """A check over labelled values; `label` and `value` are plain columns."""
    sql = ctes(t=LABELLED) + f"SELECT unit_id, {sql_columns} FROM t WHERE {sql_where}"

    @check(name, sql)
    def query(spark, sf_dir):
        df = derive(spark, sf_dir, LABELLED)
        if where is not None:
            df = df.where(where())
        return df.select("unit_id", *columns())


_PS = O.parts("label")
_LAB = "replace(lower(label), ' ', '_')"
_LPS = O.parts(_LAB)


LAB = "replace(lower(label), ' ', '_')"
PARTS = label_parts(LAB)


_labelled("o43_value_length", lambda: ["value"], "value", "length(trim(value)) >= 2",
          lambda: "length(" + strip("value") + ") >= 2")
_labelled("o44_label_words", lambda: [F.expr(f"array_join(sort_array({label_parts('label')}), ',')").alias("words")],
          f"array_to_string(list_sort({_PS}), ',') AS words")
_labelled("o45_name_fields", lambda: ["label", "value"], "label, value", O.name_field(_PS, "value"),
          lambda: fields.is_name_field(label_parts("label"), "value"))
_labelled("o46_address_fields", lambda: ["label", "value"], "label, value", O.address_field(_PS, "value"),
          lambda: fields.is_address_field(label_parts("label"), "value"))
_labelled("o50_non_pii_labels", lambda: ["label"], "label", O.non_pii(_LPS),
          lambda: context.is_non_pii_label(PARTS))
_labelled("o51_name_suppression", lambda: ["label"], "label",
          f"list_has_any({_LPS}, {O.quoted(C.NAME_SUPPRESS_PARTS)})",
          lambda: context.suppresses_name(PARTS))
_labelled("o52_address_words", lambda: ["label"], "label",
          f"list_has_any({_LPS}, {O.quoted(C.ADDRESS_PARTS)})",
          lambda: context.names_an_address(PARTS))
_labelled(
    "o53_label_keywords",
    lambda: ["label", *[F.expr(context.shares_keyword(LAB, t)).alias(t.lower()) for t in C.CONTEXT_REQUIRED]],
    "label, " + ", ".join(f"{O.keyword(_LAB, t)} AS {t.lower()}" for t in C.CONTEXT_REQUIRED),
)
_labelled(
    "o53_label_rule",
    lambda: ["label", *[F.expr(context.label_matches(LAB, PARTS, t)).alias(t.lower())
                        for t in C.CONTEXT_REQUIRED]],
    "label, " + ", ".join(f"{O.label_matches(_LAB, _LPS, t)} AS {t.lower()}" for t in C.CONTEXT_REQUIRED),
)


def _cands(spark, sf_dir, strict=True):
    """All candidates with their context verdict, one row each."""
    df = add_candidates(units(spark, sf_dir, NOTES), DetectConfig(strict=strict))
    rows = df.select("unit_id", "text", F.explode_outer("candidates").alias("c"))
    return rows.where(F.col("c.start").isNotNull()).select("unit_id", "text", "c.*")


def _ctes(strict=True):
    return {"notes": NOTES, **O.detection_ctes("notes", "unit_id", strict)}


_FINAL = "CASE WHEN verdict IN ('pass', 'boost', 'drop') THEN pii_type ELSE verdict END"
_BOOST = "round(CASE WHEN verdict = 'boost' THEN confidence + CAST(0.1 AS DOUBLE) ELSE confidence END, 2)"


def _cand_check(name, sql_select, sql_where, shape, strict=True):
    @check(name, ctes(**_ctes(strict)) + f"SELECT {sql_select} FROM judged WHERE {sql_where}")
    def query(spark, sf_dir):
        return shape(_cands(spark, sf_dir, strict))


def _pos(df, *cols):
    return df.select("unit_id", F.col("start").cast("bigint").alias("start_pos"),
                     F.col("end").cast("bigint").alias("end_pos"), *cols)


_POS = "unit_id, s AS start_pos, e AS end_pos"

AROUND = context.window(blocks("text"), "start", "`end`", C.CONTEXT_WINDOW)
FOUND_LABEL = context.label_of(context.left_side(AROUND, "start", C.CONTEXT_WINDOW))

_cand_check("o47_candidate_union", f"{_POS}, method, rank, value", "true",
            lambda df: _pos(df, "method", "rank", "value"))
_cand_check(
    "o48_bypass", f"{_POS}, pii_type, method",
    f"method = 'structured' OR NOT list_contains({O.quoted(C.CONTEXT_REQUIRED)}, pii_type)",
    lambda df: _pos(df.where((F.col("method") == "structured") | (
        F.col("keep") & F.col("pii_type").isin(C.SELF_EVIDENT))), "pii_type", "method"),
)
_cand_check(
    "o49_label_lookup", f"{_POS}, lab AS label", "true",
    lambda df: _pos(df, F.expr(FOUND_LABEL).alias("label")),
)
_cand_check("o54_confidence_boost", f"{_POS}, rank, {_BOOST} AS confidence", "verdict <> 'drop'",
            lambda df: _pos(df.where("keep"), "rank", F.round("confidence", 2).alias("confidence")))
for _strict, _suffix in ((True, "_strict"), (False, "")):
    _cand_check(
        f"o55_relabelled{_suffix}", f"{_POS}, {_FINAL} AS pii_type, value", "method = 'ner' AND verdict <> 'drop'",
        lambda df: _pos(df.where(F.col("keep") & (F.col("method") == "ner")), "pii_type", "value"), _strict,
    )
_cand_check(
    "o56_dropped_by_label", f"{_POS}, rank, value", "verdict = 'drop' AND lab <> ''",
    lambda df: _pos(
        df.where(~F.col("keep") & (F.expr(FOUND_LABEL) != "")), "rank", "value"),
)


WINDOW = f"lower({AROUND})"


def _per_type(test):
    cases = " ".join(f"WHEN '{t}' THEN {test(WINDOW, t)}" for t in C.CONTEXT_REQUIRED)
    return F.expr(f"CASE pii_type {cases} ELSE false END")


_REQ = f"list_contains({O.quoted(C.CONTEXT_REQUIRED)}, pii_type) AND method = 'regex'"
_cand_check(
    "o57_window_keyword", f"{_POS}, rank, {O.per_type(lambda t: O.any_keyword('win', C.CONTEXT_KEYWORDS[t]), 'false')} AS hit",
    _REQ,
    lambda df: _pos(df.where(F.col("pii_type").isin(C.CONTEXT_REQUIRED) & (F.col("method") == "regex")), "rank",
                    _per_type(context.has_type_keyword).alias("hit")),
)
_cand_check(
    "o58_window_person_fallback", f"{_POS}, rank, {O.per_type(lambda t: O.free_context('win', t), 'false')} AS hit",
    _REQ,
    lambda df: _pos(df.where(F.col("pii_type").isin(C.CONTEXT_REQUIRED) & (F.col("method") == "regex")), "rank",
                    _per_type(context.has_free_context).alias("hit")),
)
