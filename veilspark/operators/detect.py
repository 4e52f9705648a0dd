"""From a column of text to a column of detections. Narrow: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..config import DetectConfig
from ..functions.spans import blocks, searchable
from ..functions.text import SPACE, has_text, literal, strip
from . import fields, patterns, recogniser
from .candidates import candidate
from .context import judge
from .resolve import resolve

NER_TYPES = list(C.NER_CONFIDENCE)


def add_candidates(
    df: DataFrame,
    cfg: DetectConfig = DetectConfig(),
    text: str = "text",
    out: str = "candidates",
    label: str | None = None,
) -> DataFrame:
    """All candidates of each text, with the context verdict, before overlaps are settled.

    Works in two projections so that each pattern is searched once per text: Catalyst keeps
    them apart because the first one's results are used several times.
    """
    known = f"replace(lower(trim({label})), ' ', '_')" if label else None
    t, b = "_text", "_blocks"
    clean = F.expr(f"CASE WHEN {has_text(text)} THEN {searchable(text)} END")

    found = {f"_m_{p}": F.expr(patterns.find_pieces(t, p, cfg.strict)) for p in C.PATTERNS}
    if cfg.structured:
        found["_m_pairs"] = F.expr(fields.find_pairs(t))
    by_model = cfg.ner_fn is not None or cfg.ner_col is not None
    if by_model:
        given = [F.col(cfg.ner_col)] if cfg.ner_col else []
        given += [recogniser.entity_column(F.col(text), cfg.ner_fn)] if cfg.ner_fn else []
        found["_m_entities"] = F.array_distinct(F.concat(*given))
    elif cfg.recogniser == "cue":
        found["_m_PERSON_NAME"] = F.expr(recogniser.find_people(t))
        found["_m_ADDRESS"] = F.expr(recogniser.find_places(t))

    parts = [
        judge(b, patterns.find_spans(b, f"_m_{p}", p, cfg.strict), p, "regex", cfg, known)
        for p in C.PATTERNS
    ]
    for kind in NER_TYPES:
        if by_model:
            spans = recogniser.model_spans(b, "_m_entities", kind)
        elif cfg.recogniser == "cue":
            spans = recogniser.cue_spans(f"_m_{kind}", kind)
        else:
            continue
        parts.append(judge(b, spans, kind, "ner", cfg, known))
    if cfg.structured:
        parts.append(_structured(text, b, known))
    cands = F.expr(f"concat({', '.join(parts)})")
    staged = df.withColumn(t, clean).withColumns({b: F.expr(blocks(text)), **found})
    return staged.withColumn(out, cands).drop(t, b, *found)


def _structured(text: str, text_blocks: str, known: str | None) -> str:
    """Candidates from labels: pairs in the text, and the whole text under a known label."""
    pairs = fields.pair_spans(text_blocks, "_m_pairs")
    if known is not None:
        lead = f"length(regexp_extract({text}, {literal(f'^[{SPACE}]*')}, 0))"
        value = strip(text)
        whole = (
            f"filter(array(struct({known} AS label, {value} AS value, {lead} AS start, "
            f"{lead} + length({value}) AS `end`)), p -> p.label <> '' AND length(p.value) >= 2)"
        )
        pairs = f"concat({whole}, {pairs})"
    typed = (
        f"transform({pairs}, p -> struct(p.start AS start, p.`end` AS `end`, p.value AS value, "
        f"{fields.field_type('p.label', 'p.value')} AS kind))"
    )
    record = candidate("p", C.STRUCTURED_RANK, "p.kind", C.STRUCTURED_CONFIDENCE, "structured", "true")
    return f"transform(filter({typed}, p -> p.kind IS NOT NULL), p -> {record})"


def add_detections(
    df: DataFrame,
    cfg: DetectConfig = DetectConfig(),
    text: str = "text",
    out: str = "detections",
    label: str | None = None,
) -> DataFrame:
    """Add the final detections of each text as an array column, in text order.

    `label` names a column holding the field name of the text (a CSV header, a JSON key). Labels
    in the text itself go before it, and are all there is where it is null or missing; tables of
    both kinds can therefore be detected in one pass.
    """
    df = add_candidates(df, cfg, text, "_candidates", label)
    final = resolve("_candidates", cfg.strict)
    if cfg.min_confidence > 0:
        final = f"filter({final}, c -> c.confidence >= {cfg.min_confidence}D)"
    shaped = (
        f"transform({final}, c -> struct(c.value AS value, c.pii_type AS pii_type, "
        "c.start AS start, c.`end` AS `end`, c.confidence AS confidence, c.method AS method, "
        "c.rank AS rank))"
    )
    return df.withColumn(out, F.expr(shaped)).drop("_candidates")


def explode_detections(df: DataFrame, keys: list[str], column: str = "detections") -> DataFrame:
    """One row per detection.

    `explode_outer` plus a filter on its output: a plain explode lets Catalyst infer a
    filter on the array, which would be pushed down and evaluate all patterns twice.
    """
    rows = df.select(*keys, F.explode_outer(column).alias("d")).where(F.col("d.start").isNotNull())
    return rows.select(*keys, "d.*")


def detect_rows(
    df: DataFrame, keys: list[str], cfg: DetectConfig = DetectConfig(), text: str = "text",
    label: str | None = None,
) -> DataFrame:
    """Detections of a table of texts, one row each."""
    return explode_detections(add_detections(df, cfg, text, label=label), keys)
