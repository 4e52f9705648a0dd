"""Layer 3: does the label or the surrounding text support a candidate?

SQL expression text in and out, as in `functions.text`.
"""

from __future__ import annotations

from .. import constants as C
from ..config import DetectConfig
from ..functions.spans import slice_text
from ..functions.text import contains_any, label_parts, literal, one_of, rlike, some_of, strip
from .candidates import candidate


def window(text_blocks: str, start: str, end: str, width: int) -> str:
    """The candidate with up to `width` characters on each side."""
    begin = f"greatest({start} - {width}, 0)"
    return slice_text(text_blocks, begin, f"({end} + {width} - {begin})")


def left_side(around: str, start: str, width: int) -> str:
    """The part of a `window` left of the candidate."""
    return f"left({around}, least({start}, {width}))"


def label_of(left: str) -> str:
    """The label in front of a candidate: what stands before the last colon, back to the
    nearest pipe, comma or line start; "" if there is none."""
    after = f"substring_index({left}, ':', -1)"
    before = f"substring({left}, 1, length({left}) - length({after}) - 1)"
    for mark in ("'|'", "char(10)", "','"):
        before = f"substring_index({before}, {mark}, -1)"
    label = f"replace(lower({strip(before)}), ' ', '_')"
    return f"CASE WHEN contains({left}, ':') THEN {label} ELSE '' END"


def is_non_pii_label(parts: str) -> str:
    """Every word of the label marks a field that never holds personal data."""
    return f"(size({parts}) > 0 AND forall({parts}, w -> {one_of('w', C.NON_PII_PARTS)}))"


def suppresses_name(parts: str) -> str:
    return some_of(parts, C.NAME_SUPPRESS_PARTS)


def names_an_address(parts: str) -> str:
    return some_of(parts, C.ADDRESS_PARTS)


def shares_keyword(label: str, pii_type: str) -> str:
    """A keyword of the type occurs in the label, or the label inside a keyword."""
    keywords = C.CONTEXT_KEYWORDS[pii_type]
    inside = f"contains({literal(chr(10).join(keywords))}, {label})"
    return f"({contains_any(label, keywords)} OR {inside})"


def label_matches(label: str, parts: str, pii_type: str) -> str:
    rules = [f"NOT {is_non_pii_label(parts)}"]
    if pii_type == "PERSON_NAME":
        rules.append(f"NOT {suppresses_name(parts)}")
    if pii_type == "ADDRESS":
        rules.append(names_an_address(parts))
    return "(" + " AND ".join([*rules, shares_keyword(label, pii_type)]) + ")"


def has_type_keyword(around: str, pii_type: str) -> str:
    return contains_any(around, C.CONTEXT_KEYWORDS[pii_type])


def has_free_context(around: str, pii_type: str) -> str:
    """A keyword of the type, or any person keyword, in the lower-cased window."""
    return contains_any(around, C.CONTEXT_KEYWORDS[pii_type] + C.CONTEXT_KEYWORDS["PERSON_NAME"])


def relabel_order(pii_type: str, strict: bool) -> list[str]:
    """Types a recognised entity may be relabelled to, in fixed order."""
    allowed = C.CONTEXT_REQUIRED if strict else ["PERSON_NAME", "ADDRESS"]
    return [t for t in allowed if t != pii_type]


def relabel(label: str, parts: str, pii_type: str, strict: bool) -> str:
    """The first other type whose label rule accepts the label, else null."""
    tests = [
        f"WHEN {label_matches(label, parts, t)} THEN '{t}'"
        for t in relabel_order(pii_type, strict)
    ]
    return f"CASE {' '.join(tests)} END"


def boosted(confidence: float) -> float:
    return min(1.0, confidence + C.LABEL_BOOST)


def judge(
    text_blocks: str, spans: str, pii_type: str, method: str, cfg: DetectConfig,
    label: str | None = None,
) -> str:
    """Candidates from spans of one type, with type, confidence and `keep` decided.

    `label` is the known field name of the text, for candidates without a label of their own. The
    nested transforms give each intermediate value a name, so it is computed once per span.
    """
    if method == "regex":
        rank, confidence = C.RANK[pii_type], C.CONFIDENCE[pii_type]
    else:
        rank, confidence = C.NER_RANK, C.NER_CONFIDENCE[pii_type]
    if pii_type not in C.CONTEXT_REQUIRED:
        plain = candidate("s", rank, f"'{pii_type}'", confidence, method, "true")
        return f"transform({spans}, s -> {plain})"

    around = window(text_blocks, "s.start", "s.`end`", cfg.window)
    named = f"transform({spans}, s -> struct(s AS s, {around} AS around))"
    left = left_side("x.around", "x.s.start", cfg.window)
    named = f"transform({named}, x -> struct(x.s AS s, x.around AS around, {left} AS left))"
    found = label_of("x.left")
    if label is not None:
        # "at 12:30 …": a number before the colon is a time, no label
        own = f"CASE WHEN {rlike('l', '(?:^|_)[0-9]+$')} THEN NULL ELSE nullif(l, '') END"
        found = f"transform(array({found}), l -> coalesce({own}, {label}, ''))[0]"
    named = f"transform({named}, x -> struct(x.s AS s, x.around AS around, {found} AS label))"
    split = (
        f"transform({named}, x -> struct(x.s AS s, x.around AS around, x.label AS label, "
        f"{label_parts('x.label')} AS parts))"
    )
    fits = f"x.label <> '' AND {label_matches('x.label', 'x.parts', pii_type)}"
    tested = (
        f"transform({split}, x -> struct(x.s AS s, x.around AS around, x.label AS label, "
        f"x.label <> '' AS labelled, x.parts AS parts, {fits} AS fits))"
    )
    if method == "ner":
        other = (
            "CASE WHEN x.labelled AND NOT x.fits THEN "
            f"{relabel('x.label', 'x.parts', pii_type, cfg.strict)} END"
        )
        tested = (
            f"transform({tested}, x -> struct(x.s AS s, x.around AS around, "
            f"x.labelled AS labelled, x.fits AS fits, {other} AS other))"
        )
        final_type, accepted = f"coalesce(x.other, '{pii_type}')", "x.fits OR x.other IS NOT NULL"
    else:
        final_type, accepted = f"'{pii_type}'", "x.fits"
    free = f"transform(array(lower(x.around)), a -> {has_free_context('a', pii_type)})[0]"
    keep = f"CASE WHEN x.labelled THEN {accepted} ELSE {free} END"
    final_conf = f"CASE WHEN x.fits THEN {boosted(confidence)!r}D ELSE {confidence!r}D END"
    return f"transform({tested}, x -> {candidate('x.s', rank, final_type, final_conf, method, keep)})"
