"""The candidate record that the detection steps pass on."""

from __future__ import annotations

# Field order matters: arrays of candidates sort by start, end, rank.
CANDIDATES = (
    "array<struct<start:int,end:int,rank:int,pii_type:string,confidence:double,"
    "method:string,value:string,keep:boolean>>"
)


def candidate(span: str, rank: int, pii_type: str, confidence: str, method: str, keep: str) -> str:
    """Build one record from a span (anything with start, end and value fields)."""
    return (
        f"struct({span}.start AS start, {span}.`end` AS `end`, {rank} AS rank, "
        f"{pii_type} AS pii_type, cast({confidence} AS double) AS confidence, "
        f"'{method}' AS method, {span}.value AS value, {keep} AS keep)"
    )


def overlaps(a: str, b: str) -> str:
    """Two half-open ranges share a character; touching ranges do not."""
    return f"(greatest({a}.start, {b}.start) < least({a}.`end`, {b}.`end`))"
