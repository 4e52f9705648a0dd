"""Layer 1: spans of the nine identifier patterns."""

from __future__ import annotations

from .. import constants as C
from ..functions.spans import char_at, cut, locate
from ..functions.text import literal, rlike

# A local part never contains "@", so it may be matched without giving characters back;
# long tokens without "@" then cost one scan instead of two.
_LOCAL_PART = "[A-Za-z0-9._%+-]+@"
_LOCAL_PART_NO_BACKTRACK = "[A-Za-z0-9._%+-]++@"


def pattern_for(pii_type: str, strict: bool = True) -> str:
    """The pattern of a type."""
    pattern = C.RELAXED_PHONE if pii_type == "PHONE_NUMBER" and not strict else C.PATTERNS[pii_type]
    return pattern.replace(_LOCAL_PART, _LOCAL_PART_NO_BACKTRACK)


# A run of digits that every hit of the type holds. Several types share the four-digit
# test, which Catalyst then evaluates once per text.
_DIGITS = {
    "AADHAAR": r"\p{Nd}{4}",
    "PAN": r"\p{Nd}{4}",
    "PHONE_NUMBER": r"\p{Nd}{4}",
    "PASSPORT": r"\p{Nd}{4}",
    "BANK_ACCOUNT": r"\p{Nd}{4}",
}
# A character that every hit of the type holds.
_MARK = {"EMAIL_ADDRESS": "@", "UPI_ID": "@", "IFSC": "0", "VOTER_ID": "/"}
# A closer test for the texts that pass the first.
_SHAPE = {
    "PAN": r"[A-Z]\p{Nd}{4}[A-Z]",
    "PHONE_NUMBER": r"[6-9]\p{Nd}{9}",
    "PASSPORT": r"[A-Z]\p{Nd}{7}",
    "BANK_ACCOUNT": r"\p{Nd}{9}",
    "IFSC": r"[A-Z]0[A-Z0-9]{6}",
    "VOTER_ID": r"[A-Z]/\p{Nd}{2}/",
}


def gate(text: str, pii_type: str) -> str:
    """Cheap test every text with a hit passes; the others skip the full pattern."""
    if pii_type in _DIGITS:
        test = rlike(text, _DIGITS[pii_type])
    else:
        test = f"contains({text}, {literal(_MARK[pii_type])})"
    return f"{test} AND {rlike(text, _SHAPE[pii_type])}" if pii_type in _SHAPE else test


def find_pieces(text: str, pii_type: str, strict: bool = True) -> str:
    """Pieces of a `searchable` text, cut at the hits of one type."""
    return cut(text, pattern_for(pii_type, strict), gate(text, pii_type))


def find_spans(text_blocks: str, pieces: str, pii_type: str, strict: bool = True) -> str:
    """Spans of one type with that type's own acceptance rule."""
    spans = locate(pieces)
    if pii_type == "AADHAAR":
        spans = f"filter({spans}, s -> length(regexp_replace(s.value, '[ -]', '')) = 12)"
        if not strict:
            phone = rlike("s.value", r"^91[6-9]\p{Nd}{9}\z")
            signed = f"s.start > 0 AND {char_at(text_blocks, '(s.start - 1)')} = '+'"
            spans = f"filter({spans}, s -> NOT ({phone} AND {signed}))"
    if pii_type == "UPI_ID":
        spans = f"filter({spans}, s -> {char_at(text_blocks, 's.`end`')} <> '.')"
    return spans
