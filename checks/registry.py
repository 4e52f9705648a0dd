"""Where the checks are collected."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The key of the checks; the library itself has none.
KEY = "key for the checks only"


def check(name: str, sql: str | None = None):
    """Register a query `fn(spark, sf_dir)` and the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
