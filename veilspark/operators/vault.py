"""Tokens for values, and the encrypted table that leads back to the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.crypto import decrypt_or_mark, encrypt, hmac_hex

# 96 bits: among ten billion values of one file, two share a token with a chance below 1e-8.
TOKEN_DIGITS = 24
# Sixteen letters instead of hex digits, so that no token reads as a telephone or card number.
LETTERS = "ABCDEFGHIJKLMNOP"
WIDE_DIGITS = 12


def token_prefix(pii_type: Column) -> Column:
    pairs = [F.lit(x) for pair in C.TOKEN_PREFIX.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), pii_type), pii_type)


def token_digest(key: str, file: Column, value: Column) -> Column:
    """Keyed hash of (file, value), upper-case hex. Keyed, because a plain hash of a
    ten-digit number could be searched; deterministic, so a retried task or a second run
    gives the same token."""
    return F.upper(hmac_hex(key, F.concat_ws("\x1f", file.cast("string"), value)))


def distinct_values(detections: DataFrame, file: str = "file_id", unit: str = "unit_id") -> DataFrame:
    """One row per file and text, with the type of its first detection in priority order
    and the number of its detections.

    All detections of one text are equally wide, so the order is confidence, rank, then
    position. A grouped minimum: combined before the shuffle, so a text that fills a third
    of the corpus arrives as one row per task.
    """
    order = F.struct(
        (-F.col("confidence")).alias("a"), F.col("rank").alias("b"),
        F.col(unit).alias("c"), F.col("start").alias("d"),
    )
    return detections.groupBy(file, "value").agg(
        F.min_by("pii_type", order).alias("pii_type"), F.count("*").alias("n_found")
    )


def assign_tokens(
    values: DataFrame, key: str, file: str = "file_id", digits: int | None = None
) -> DataFrame:
    """Add a token `PREFIX_` and 24 letters: a function of file, type and value alone.

    Narrow, and independent of the other values of the run, so a value keeps its token however
    its file is spread over runs and batches. The fixed length closes the token: what follows
    it in a text is never read as part of it.

    `digits` asks for short tokens instead, unique within this one table only: see
    `short_tokens`.
    """
    if digits is not None:
        return short_tokens(values, key, file, digits)
    digest = F.substring(token_digest(key, F.col(file), F.col("value")), 1, TOKEN_DIGITS)
    letters = F.translate(digest, "0123456789ABCDEF", LETTERS)
    return values.withColumn("token", F.concat_ws("_", token_prefix(F.col("pii_type")), letters))


def short_tokens(
    values: DataFrame, key: str, file: str = "file_id", digits: int = 5
) -> DataFrame:
    """Add a token `PREFIX_XXXXX` that is unique within its file, for tables that hold all
    values of their files.

    Values whose short digits collide get twelve digits instead, and the full digest if
    even those collide. Both counts use one shuffle, on (file, prefix, short digits): at
    most sixteen-to-the-fifth groups per file and type, none of them large.
    """
    full = values.withColumn("prefix", token_prefix(F.col("pii_type"))).withColumn(
        "digest", token_digest(key, F.col(file), F.col("value"))
    )
    short, wide = F.substring("digest", 1, digits), F.substring("digest", 1, WIDE_DIGITS)
    marked = full.withColumn("_short", short).withColumn("_wide", wide)
    same_short = W.partitionBy(file, "prefix", "_short")
    same_wide = W.partitionBy(file, "prefix", "_short", "_wide")
    chosen = (
        F.when(F.col("_n_short") == 1, F.col("_short"))
        .when(F.col("_n_wide") == 1, F.col("_wide"))
        .otherwise(F.col("digest"))
    )
    return (
        marked.withColumn("_n_wide", F.count("*").over(same_wide))
        .withColumn("_n_short", F.count("*").over(same_short))
        .withColumn("token", F.concat_ws("_", "prefix", chosen))
        .drop("_short", "_wide", "_n_short", "_n_wide", "digest", "prefix")
    )


def keep_earlier(tokens: DataFrame, earlier: DataFrame, file: str = "file_id") -> DataFrame:
    """`assign_tokens` output in which values that an earlier vault knows keep their token and
    type there: a value of several types has one prefix, however its file is spread over runs.

    The letters of a token stand for file and value, so the ciphertexts need not be opened.
    Joined on (file, letters): one row per value on each side, no key is large.
    """
    letters = F.substring("token", -TOKEN_DIGITS, TOKEN_DIGITS)
    known = earlier.groupBy(file, letters.alias("_letters")).agg(
        F.min(F.struct("token", "pii_type")).alias("_known"))
    kept = {c: F.coalesce(F.col(f"_known.{c}"), F.col(c)) for c in ("token", "pii_type")}
    return (
        tokens.withColumn("_letters", letters).join(known, [file, "_letters"], "left")
        .withColumns(kept).select(*tokens.columns)
    )


def encrypt_values(tokens: DataFrame, key: str) -> DataFrame:
    """Replace the value by its ciphertext. The IV is random, so write the result once and
    read it back; never compute it twice."""
    return tokens.withColumn("encrypted_original", encrypt(key, F.col("value"))).drop("value")


def reverse_tokens(
    vault: DataFrame, key: str, file_id=None, tokens: DataFrame | None = None,
    file: str = "file_id",
) -> DataFrame:
    """Tokens with their values, for one file and an optional list of tokens (a table with
    a `token` column; none means all). Filters run before anything is decrypted."""
    picked = vault if file_id is None else vault.where(F.col(file) == file_id)
    if tokens is not None:
        picked = picked.join(tokens.select("token"), "token", "left_semi")
    return picked.select(
        file, "token", decrypt_or_mark(key, F.col("encrypted_original")).alias("value")
    )


def merged(vault: DataFrame, file: str = "file_id") -> DataFrame:
    """One entry per file and token out of the entries of many runs or batches: the earliest.
    Each run seals a value anew, so the ciphertexts of one token differ; the value does not."""
    cols = [c for c in vault.columns if c not in (file, "token")]
    counted = "n_found" in cols
    first = F.min_by(F.struct(*cols), F.struct("created_at", "encrypted_original"))
    entries = vault.groupBy(file, "token").agg(
        first.alias("e"), *([F.sum("n_found").alias("_n")] if counted else []))
    kept = [F.col("_n" if c == "n_found" else f"e.{c}").alias(c) for c in cols]
    return entries.select(file, "token", *kept)


def vault_listing(vault: DataFrame, file_id=None, file: str = "file_id") -> DataFrame:
    """Vault entries without the ciphertext."""
    picked = vault if file_id is None else vault.where(F.col(file) == file_id)
    return picked.drop("encrypted_original", "value")


def search(vault: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Entries in which any of the columns contains the query, ignoring case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return vault.where(hit)


def with_revealed(vault: DataFrame, revealed: DataFrame, file: str = "file_id") -> DataFrame:
    """Vault entries with the revealed value, or a dash where none was revealed."""
    values = revealed.select(file, "token", F.col("value").alias("revealed"))
    return vault.join(values, [file, "token"], "left").withColumn(
        "revealed", F.coalesce("revealed", F.lit("—"))
    )


def drop_files(table: DataFrame, removed: DataFrame, file: str = "file_id") -> DataFrame:
    """The rows of a vault or report table that remain once the given files are removed."""
    return table.join(removed.select(file).distinct(), file, "left_anti")
