"""Which of several overlapping candidates stay. Array steps are SQL expression text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.spans import CHUNK, chunks
from .candidates import CANDIDATES, overlaps

# Types that give way to every earlier-ranked pattern hit they overlap.
YIELDING = ", ".join(str(C.RANK[t]) for t in ("BANK_ACCOUNT", "IFSC", "UPI_ID"))
NONE = f"cast(array() AS {CANDIDATES})"


def exclude(cands: str) -> str:
    """Drop bank, IFSC and UPI candidates that overlap a candidate accepted before them."""
    ordered = (
        f"transform(sort_array(transform({cands}, c -> struct(c.rank AS r, c.start AS b, c AS c))),"
        " x -> x.c)"
    )
    return (
        f"aggregate({ordered}, {NONE}, (acc, c) -> "
        f"CASE WHEN c.rank IN ({YIELDING}) AND exists(acc, a -> {overlaps('a', 'c')}) THEN acc "
        "ELSE concat(acc, array(c)) END)"
    )


def by_priority(cands: str) -> str:
    """Widest first, then highest confidence, then rank and position."""
    return (
        f"transform(sort_array(transform({cands}, c -> struct(c.start - c.`end` AS w, "
        "-c.confidence AS n, c.rank AS r, c.start AS b, c AS c))), x -> x.c)"
    )


def greedy(cands: str) -> str:
    """Take candidates in priority order, skipping any that overlaps one already taken."""
    return (
        f"aggregate({by_priority(cands)}, {NONE}, (acc, c) -> "
        f"CASE WHEN exists(acc, a -> {overlaps('a', 'c')}) THEN acc "
        "ELSE concat(acc, array(c)) END)"
    )


def kept(cands: str) -> str:
    return f"filter({cands}, c -> c.keep)"


def settle(cands: str, strict: bool) -> str:
    """Exclusion, context verdict and greedy choice for candidates that may conflict."""
    survivors = kept(exclude(cands)) if strict else exclude(kept(cands))
    chosen = f"CASE WHEN size({cands}) > 1 THEN {greedy(survivors)} ELSE {kept(cands)} END"
    # nothing to choose among what the context supports
    return chosen if strict else f"CASE WHEN size({kept(cands)}) <= 1 THEN {kept(cands)} ELSE {chosen} END"


def resolve(cands: str, strict: bool = False) -> str:
    """Non-overlapping detections of one text, in text order.

    Candidates are walked by position and cut into islands: a candidate that starts at or
    after everything before it ends opens a new island. Only candidates of one island can
    conflict, so the quadratic choice is made per island and a long text with thousands of
    hits stays cheap.
    """
    walked = f"""aggregate(
      {chunks('s')},
      struct({NONE} AS done, {NONE} AS island, -1 AS reach),
      (o, chunk) -> aggregate(chunk,
        struct({NONE} AS done, o.island AS island, o.reach AS reach),
        (w, next) -> CASE WHEN next.start >= w.reach
          THEN struct(concat(w.done, {settle('w.island', strict)}) AS done,
                      array(next) AS island, next.`end` AS reach)
          ELSE struct(w.done AS done, concat(w.island, array(next)) AS island,
                      greatest(w.reach, next.`end`) AS reach) END,
        r -> struct(concat(o.done, r.done) AS done, r.island AS island, r.reach AS reach)),
      o -> concat(o.done, {settle('o.island', strict)}))"""
    # up to one chunk: the islands by where they open, as the state above is copied at every step
    opens = ("filter(sequence(0, size(s) - 1), i -> "
             "CASE WHEN i = 0 THEN true ELSE s[i].start >= array_max(slice(ends, 1, i)) END)")
    islands = "transform(opens, (o, k) -> slice(s, o + 1, coalesce(get(opens, k + 1), size(s)) - o))"
    cut = f"transform(array(transform(s, c -> c.`end`)), ends -> transform(array({opens}), opens -> {islands})[0])[0]"
    few = f"flatten(transform({cut}, island -> {settle('island', strict)}))"
    return f"""
    CASE WHEN size({cands}) = 0 THEN {NONE} WHEN size({cands}) = 1 THEN {kept(cands)}
      WHEN size({cands}) <= {CHUNK} THEN transform(array(sort_array({cands})), s -> {few})[0]
      WHEN size({cands}) > {CHUNK} THEN transform(array(sort_array({cands})), s -> {walked})[0]
      ELSE {NONE} END"""


def without_overlaps(spans: DataFrame, against: DataFrame, key: list[str]) -> DataFrame:
    """Exclusion for spans kept as tables: rows of `spans` that overlap no row of `against`
    in the same text. An equi-join on the key with the range test as residual."""
    a, b = spans.alias("a"), against.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    touch = F.greatest(F.col("a.start"), F.col("b.start")) < F.least(
        F.col("a.end"), F.col("b.end")
    )
    return a.join(b, [*same, touch], "left_anti")


def add_islands(spans: DataFrame, key: list[str]) -> DataFrame:
    """Island number per span row, for spans that are kept as a table."""
    by_start = W.partitionBy(*key).orderBy("start", "end", "rank")
    before = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start") >= F.coalesce(before, F.lit(-1)), 1).otherwise(0)
    return spans.withColumn("_opens", opens).withColumn(
        "island", F.sum("_opens").over(by_start.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_opens")


def duplicate_spans(detections: DataFrame, key: list[str]) -> DataFrame:
    """Spans reported more than once for a text; must be empty."""
    return (
        detections.groupBy(*key, "start", "end")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
