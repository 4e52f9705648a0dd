"""Mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent a and normalised: a = 1 keeps the
corpus as it is, a = 0 makes all sources equal. The exponent is bisected: the smallest one at
which no source is repeated more often than allowed, and, above it, the one at which the
mixture's entropy comes down to the target. Each pass over the table of sources evaluates
fifteen exponents, which is four halvings; only their sums reach the driver.

The weights are realised in blocks: documents are dealt into blocks of a source by a hash of
their id, and a source's stream is its blocks in a new permutation for every round until the
source's budget of tokens is used. The budget is the smallest at which every source is used
completely at least once, so mixing repeats but never drops.

Cases. A null source is a source of its own, a null id is dealt like any value. Null or empty
texts have no tokens, take nothing of a budget and come once per full round. Repeated rows are
rows of their own. No token at all: every row once. Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, by_shuffle, stage

ENTROPY = 0.95  # target share of the entropy of equal weights
MAX_REPEATS = 2.0  # rounds through the most repeated source
BLOCKS = 4096  # per source: the finest share of a source that a budget can take
SEED = 17
HALVINGS = 32


def token_count(text: Column) -> Column:
    """Words between ASCII spaces."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _bisect(sources: DataFrame, value, ok) -> float:
    """The smallest exponent in [0, 1] for which `ok(value at it)`; ok holds from there to 1.
    `value` makes an aggregate of one exponent."""
    low, high = 0.0, 1.0
    if ok(sources.agg(value(0.0)).first()[0]):
        return 0.0
    for _ in range(HALVINGS // 4):
        grid = [low + (high - low) * k / 16 for k in range(1, 16)]
        row = sources.agg(*[value(a) for a in grid]).first()
        good = [k for k, v in enumerate(row) if ok(v)]
        first = good[0] if good else 15
        low, high = ([low] + grid)[first], (grid + [high])[first]
    return high


def exponent(sources: DataFrame, entropy: float, max_repeats: float) -> float:
    """The mixing exponent for a table with `share` (positive) and `top` (the largest share)."""
    count = sources.count()
    if count < 2:
        return 1.0

    def entropy_of(a: float) -> Column:
        mass = F.pow("share", F.lit(a))
        total = F.sum(mass)
        return F.log(total) - F.sum(mass * F.lit(a) * F.log("share")) / total

    def repeats(a: float) -> Column:
        # with the largest source used once, a source comes (top / share) ** (1 - a) times
        return F.max(F.pow(F.col("top") / F.col("share"), F.lit(1 - a)))

    flat = _bisect(sources, repeats, lambda v: v <= max_repeats)
    # entropy falls from a = 0 to 1: the exponent at which it has come down to the target
    target = entropy * math.log(count)
    spread = _bisect(sources, entropy_of, lambda v: v <= target + 1e-12) if (
        sources.agg(entropy_of(1.0)).first()[0] <= target) else 1.0
    return max(flat, spread)


def _keys(docs: DataFrame, id_col: str, source_col: str) -> tuple[Column, Column]:
    """A document's source and its block within the source."""
    block = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(SEED)), F.lit(BLOCKS)).cast("int")
    return F.col(f"`{source_col}`").alias("source"), block.alias("block")


def plan(
    counted: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """(source, block, round, weight, place): one row per use of a block, from the rows
    (source, block, n_tokens). A block's place in the mixture goes from 0 to 1."""
    blocks = stage(counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "blocks")
    sources = stage(blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens")), "sources")
    filled = sources.where("tokens > 0")
    total, largest = filled.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        once = F.lit(1.0).alias("rounds"), F.lit(0.0).alias("weight")
        weighted = sources.select("source", "tokens", *once)
    else:
        shares = filled.select(
            (F.col("tokens") / total).alias("share"), F.lit(largest / total).alias("top"))
        a = exponent(shares, entropy, max_repeats)
        mass = F.pow(F.col("tokens") / total, F.lit(a))
        norm = filled.agg(F.sum(mass)).first()[0]
        empty = F.col("tokens") == 0
        # weight / share, scaled so that the source with the smallest ratio comes once
        rounds = F.pow(F.lit(float(largest)) / F.col("tokens"), F.lit(1 - a))
        weighted = sources.select(
            "source", "tokens", F.when(empty, 1.0).otherwise(rounds).alias("rounds"),
            F.when(empty, 0.0).otherwise(mass / norm).alias("weight"))

    same = blocks["source"].eqNullSafe(weighted["source"])
    joined = blocks.join(weighted, same).drop(weighted["source"])
    whole = F.floor("rounds")
    # at most BLOCKS rows per source
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED), whole, "source", "block"), "block")
    used = F.sum("block_tokens").over(order.rowsBetween(W.unboundedPreceding, 0))
    last = (F.col("block_tokens") > 0) & (used <= F.col("tokens") * (F.col("rounds") - whole))
    rounds = F.sequence(F.lit(0), (whole - 1 + F.coalesce(last, F.lit(False)).cast("int")).cast("int"))
    uses = joined.withColumn("_rounds", rounds).withColumn("round", F.explode("_rounds"))
    shuffled = F.pmod(F.xxhash64(F.lit(SEED), F.col("round").cast("bigint"), "source", "block"), F.lit(1 << 30))
    place = (F.col("round") + shuffled / float(1 << 30)) / F.greatest("rounds", F.col("round") + F.lit(1.0))
    return uses.select("source", "block", "round", "weight", place.alias("place"))


def _uses(docs: DataFrame, id_col: str, text_col: str, source_col: str, entropy: float, max_repeats: float):
    """The documents as rows (doc, source, block), and the plan."""
    source, block = _keys(docs, id_col, source_col)
    counted = docs.select(source, block, token_count(F.col(f"`{text_col}`")).alias("n_tokens"))
    planned = stage(plan(counted, entropy, max_repeats), "plan")
    return source, block, planned


def _join(rows: DataFrame, planned: DataFrame) -> DataFrame:
    same = rows["source"].eqNullSafe(planned["source"]) & (rows["block"] == planned["block"])
    return rows.join(by_shuffle(planned), same).drop(planned["source"], planned["block"])


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """The mixture as rows (doc_id, source, n_tokens, weight, block, round, place): one per
    use of a document. Reading by `place` meets the sources at their weights throughout."""
    source, block, planned = _uses(docs, id_col, text_col, source_col, entropy, max_repeats)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), source, block,
        token_count(F.col(f"`{text_col}`")).alias("n_tokens"))
    return _join(rows, planned).select(
        "doc_id", "source", "n_tokens", "weight", "block", "round", "place")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """The documents with all their columns, each as often as the mixture uses it, in the
    mixture's order over the written files."""
    source, block, planned = _uses(docs, id_col, text_col, source_col, entropy, max_repeats)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), source, block)
    ordered = _join(rows, planned).select("doc", "place").repartitionByRange("place")
    return ordered.sortWithinPartitions("place").select("doc.*")
