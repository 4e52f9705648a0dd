"""Registered queries: each runs a library operator on the given tables, most with the same
result stated in SQL."""

from . import fields, files, folders, govern, masking, names, resolve, risk, spans, tokens  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
