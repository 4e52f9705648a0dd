"""Layer 2: names and addresses announced by a label."""

from __future__ import annotations

from .. import constants as C
from ..functions.spans import cut, locate, with_original_values
from ..functions.text import (
    SPACE, contains_any, label_parts, literal, rlike, some_of, strip, unicode_pattern,
)

# (?d): only "\n" ends a line; (?m): "$" also matches before it. The label gives no character
# back, as a shorter one could not be followed by the colon either.
PAIR = "(?dm)" + C.PAIR_PATTERN.replace(r"([\w.]+)", r"([\w.]++)")
_HEAD = unicode_pattern(r"^[\w.]+\s*:\s*")
_LABEL = unicode_pattern(r"^([\w.]+)")


_RELEVANT = r"(?i)^[\p{L}\p{N}_.]*(?:" + "|".join(C.NAME_PARTS + C.ADDRESS_PARTS) + ")"


def find_pairs(text: str, only_relevant: bool = True) -> str:
    """Pieces of a `searchable` text, cut at its `label: value` pairs. With `only_relevant`,
    texts without any name or address word are skipped: none of their pairs can lead to a
    detection."""
    test = f"contains({text}, ':')"
    if only_relevant:
        test += " AND " + contains_any(f"lower({text})", C.NAME_PARTS + C.ADDRESS_PARTS)
    return cut(text, PAIR, test)


def pair_spans(text_blocks: str, pieces: str, only_relevant: bool = True) -> str:
    """Array of (label, value, start, end); the offsets are those of the trimmed value."""
    pairs = with_original_values(text_blocks, locate(pieces))
    if only_relevant:
        pairs = f"filter({pairs}, s -> {rlike('s.value', _RELEVANT)})"
    raw = f"regexp_replace(s.value, {literal(_HEAD)}, '')"
    label = f"lower(regexp_extract(s.value, {literal(_LABEL)}, 1))"
    halves = (
        f"transform({pairs}, s -> struct({label} AS label, {raw} AS raw, s.`end` AS `end`))"
    )
    value = strip("p.raw")
    begin = "p.`end` - length(p.raw)"
    trimmed = (
        f"transform({halves}, p -> struct(p.label AS label, {value} AS value, "
        f"{begin} AS start, {begin} + length({value}) AS `end`))"
    )
    return f"filter({trimmed}, p -> length(p.value) >= 2)"


def names_a_person(parts: str) -> str:
    return some_of(parts, C.NAME_PARTS)


def is_name_field(parts: str, value: str) -> str:
    """The label names a person, has no word speaking against it, and some word of the
    value is all letters."""
    letters = rlike(value, rf"(?:^|[{SPACE}])\p{{L}}+(?:[{SPACE}]|\z)")
    against = some_of(parts, C.NAME_SUPPRESS_PARTS)
    return f"({names_a_person(parts)} AND NOT {against} AND {letters})"


def is_address_field(parts: str, value: str) -> str:
    """The label names an address and no person; the value has five characters or more."""
    address = some_of(parts, C.ADDRESS_PARTS)
    return f"(NOT {names_a_person(parts)} AND {address} AND length({value}) >= 5)"


def field_type(label: str, value: str) -> str:
    """PERSON_NAME, ADDRESS or null for a labelled value."""
    chosen = (
        f"CASE WHEN {is_name_field('parts', value)} THEN 'PERSON_NAME' "
        f"WHEN {is_address_field('parts', value)} THEN 'ADDRESS' END"
    )
    # one-element array: the words of the label are cut once
    return f"transform(array({label_parts(label)}), parts -> {chosen})[0]"
