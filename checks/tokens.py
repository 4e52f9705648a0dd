"""Tokens, encryption and the vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import crypto
from veilspark.operators import skew, vault
from veilspark.operators.detect import detect_rows
from veilspark.plans.batch import stage

from . import oracle as O
from .data import NOTES, PEOPLE, ROWS, ctes, derive, units
from .registry import KEY, check

# Notes and rendered rows; ids of the two do not meet.
UNITS = f"""
SELECT unit_id, file_id, text FROM ({NOTES}) n
UNION ALL SELECT unit_id + 1000000000 AS unit_id, file_id, text FROM ({ROWS}) r"""
DET = {"t": UNITS, **O.detection_ctes("t", "unit_id, file_id", False)}
VAULT = {**DET, **O.vault_ctes()}


def detections(spark, sf_dir):
    return detect_rows(units(spark, sf_dir, UNITS), ["file_id", "unit_id"])


def tokens(spark, sf_dir):
    """Values with tokens, written once as the vault steps expect."""
    values = vault.distinct_values(detections(spark, sf_dir))
    return stage(vault.assign_tokens(values, KEY), "check-tokens")


def sealed(spark, sf_dir):
    """The vault proper: ciphertext instead of values."""
    return stage(vault.encrypt_values(tokens(spark, sf_dir), KEY), "check-vault")


_TYPES = f"""
SELECT c_custkey, split_part('{','.join([*O.C.TOKEN_PREFIX, 'GSTIN'])}', ',', CAST(c_custkey % 12 + 1 AS INT)) AS pii_type, mobile
FROM ({PEOPLE}) p"""


@check("o79_token_prefix", ctes(t=_TYPES) + f"SELECT c_custkey, pii_type, {O.prefix()} AS prefix FROM t")
def o79(spark, sf_dir):
    return derive(spark, sf_dir, _TYPES).select(
        "c_custkey", "pii_type", vault.token_prefix(F.col("pii_type")).alias("prefix"))


_MESSAGE = "concat(CAST(c_custkey % 20 AS STRING), chr(31), mobile)"


@check("o80_keyed_tokens", ctes(p=PEOPLE) + f"""
SELECT c_custkey, upper({O.hmac_hex(_MESSAGE)}) AS digest FROM p""")
def o80(spark, sf_dir):
    return derive(spark, sf_dir, PEOPLE).select(
        "c_custkey", vault.token_digest(KEY, F.col("c_custkey") % 20, F.col("mobile")).alias("digest"))


@check("o80_keyed_tokens_long_key", ctes(p=PEOPLE) + f"""
SELECT c_custkey, upper({O.hmac_hex(_MESSAGE, KEY * 5)}) AS digest FROM p""")
def o80_long(spark, sf_dir):
    digest = vault.token_digest(KEY * 5, F.col("c_custkey") % 20, F.col("mobile"))
    return derive(spark, sf_dir, PEOPLE).select("c_custkey", digest.alias("digest"))


# Two digits only, so that almost every token collides first.
@check("o81_unique_tokens_after_collision", ctes(p=PEOPLE, d=f"""
SELECT c_custkey % 3 AS file_id, mobile AS value, upper({O.hmac_hex("concat(CAST(c_custkey % 3 AS STRING), chr(31), mobile)")}) AS h FROM p""") + """
SELECT file_id, value, concat('PHONE_', CASE WHEN count(*) OVER (PARTITION BY file_id, substr(h, 1, 2)) = 1
  THEN substr(h, 1, 2) ELSE substr(h, 1, 12) END) AS token FROM d""")
def o81(spark, sf_dir):
    values = derive(spark, sf_dir, PEOPLE).selectExpr(
        "c_custkey % 3 AS file_id", "mobile AS value", "'PHONE_NUMBER' AS pii_type")
    return vault.assign_tokens(values, KEY, digits=2).select("file_id", "value", "token")


@check("o81_tokens_are_unique", "SELECT CAST(0 AS BIGINT) AS shared")
def o81_unique(spark, sf_dir):
    per_token = tokens(spark, sf_dir).groupBy("file_id", "token").agg(F.count("*").alias("n"))
    return per_token.where("n > 1").agg(F.count("*").alias("shared"))


@check("o82_one_token_per_value", ctes(**VAULT) + "SELECT file_id, value, pii_type, n_found, token FROM vault")
def o82(spark, sf_dir):
    return tokens(spark, sf_dir).select("file_id", "value", "pii_type", "n_found", "token")


# The same text under several types: confidence, then rank, then position decide.
_TWICE = f"""
SELECT c_custkey AS unit_id, c_custkey % 20 AS file_id, full_name AS value,
  CASE c_custkey % 3 WHEN 0 THEN 'PERSON_NAME' WHEN 1 THEN 'ADDRESS' ELSE 'PHONE_NUMBER' END AS pii_type,
  CASE c_custkey % 4 WHEN 0 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS confidence,
  CASE c_custkey % 5 WHEN 0 THEN 10 ELSE 11 END AS rank, CAST(c_custkey % 7 AS INT) AS start
FROM ({PEOPLE}) p"""


@check("o82_type_of_first_detection", ctes(t=_TWICE) + """
SELECT file_id, value, pii_type FROM (SELECT *, row_number() OVER (PARTITION BY file_id, value
  ORDER BY confidence DESC, rank, unit_id, start) AS k FROM t) WHERE k = 1""")
def o82_first(spark, sf_dir):
    return vault.distinct_values(derive(spark, sf_dir, _TWICE)).drop("n_found")


@check("o83_encrypt", ctes(p=PEOPLE) + """
SELECT full_name, CAST(16 + 16 * (octet_length(CAST(full_name AS BLOB)) // 16 + 1) AS BIGINT) AS cipher_bytes,
  count(*) AS ciphertexts FROM p GROUP BY ALL""")
def o83(spark, sf_dir):
    """Equal names get different ciphertexts of the expected length."""
    sealed_names = derive(spark, sf_dir, PEOPLE).select(
        "full_name", crypto.encrypt(KEY, F.col("full_name")).alias("c"))
    return sealed_names.groupBy("full_name").agg(
        F.max(F.octet_length(F.unbase64("c"))).cast("bigint").alias("cipher_bytes"),
        F.count_distinct("c").alias("ciphertexts"))


@check("o84_key_is_padded_or_cut", ctes(p=PEOPLE) + "SELECT c_custkey, mobile AS short, email AS long FROM p")
def o84(spark, sf_dir):
    long = KEY * 3
    return derive(spark, sf_dir, PEOPLE).select(
        "c_custkey",
        crypto.decrypt("k" + "\0" * 31, crypto.encrypt("k", F.col("mobile"))).alias("short"),
        crypto.decrypt(long[:32], crypto.encrypt(long, F.col("email"))).alias("long"))


@check("o85_decrypt_round_trip", ctes(p=PEOPLE) + "SELECT c_custkey, address, aadhaar FROM p")
def o85(spark, sf_dir):
    def back(c):
        return crypto.decrypt(KEY, crypto.encrypt(KEY, F.col(c))).alias(c)

    return derive(spark, sf_dir, PEOPLE).select("c_custkey", back("address"), back("aadhaar"))


@check("o86_decryption_errors_marked", ctes(p=PEOPLE) + f"""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{O.C.DECRYPTION_ERROR}' ELSE mobile END AS value FROM p""")
def o86(spark, sf_dir):
    damaged = F.when(F.col("c_custkey") % 6 == 0, F.base64(F.lit(b"\0" * 48))).when(
        F.col("c_custkey") % 3 == 0, F.lit("not base64!")).otherwise(crypto.encrypt(KEY, F.col("mobile")))
    return derive(spark, sf_dir, PEOPLE).select(
        "c_custkey", crypto.decrypt_or_mark(KEY, damaged).alias("value"))


@check("o87_reverse_file", ctes(**VAULT) + "SELECT file_id, token, value FROM vault WHERE file_id = 0")
def o87(spark, sf_dir):
    return vault.reverse_tokens(sealed(spark, sf_dir), KEY, file_id=0)


@check("o87_reverse_listed_tokens", ctes(**VAULT) + """
SELECT file_id, token, value FROM vault WHERE token LIKE 'PHONE_%' OR token LIKE 'PAN_%'""")
def o87_list(spark, sf_dir):
    table = sealed(spark, sf_dir)
    wanted = table.where(F.col("token").rlike("^(PHONE|PAN)_")).select("token")
    return vault.reverse_tokens(table, KEY, tokens=wanted)


@check("o88_vault_listing", ctes(**VAULT) + "SELECT file_id, pii_type, n_found, token FROM vault WHERE file_id = 0")
def o88(spark, sf_dir):
    return vault.vault_listing(sealed(spark, sf_dir), 0)


@check("o89_vault_search", ctes(**VAULT) + """
SELECT file_id, token, pii_type, value FROM vault
WHERE contains(lower(token), 'user1') OR contains(lower(pii_type), 'user1') OR contains(lower(value), 'user1')""")
def o89(spark, sf_dir):
    revealed = tokens(spark, sf_dir).drop("n_found")
    return vault.search(revealed, "USER1", ["token", "pii_type", "value"])


@check("o90_cascade_delete", ctes(**VAULT) + "SELECT file_id, token, value FROM vault WHERE file_id % 4 <> 0")
def o90(spark, sf_dir):
    table = tokens(spark, sf_dir)
    removed = table.where("file_id % 4 = 0").select("file_id")
    return vault.drop_files(table, removed).select("file_id", "token", "value")


@check("o114_vault_with_revealed_values", ctes(**VAULT) + """
SELECT file_id, token, CASE WHEN pii_type = 'PERSON_NAME' THEN value ELSE '—' END AS revealed,
  row_number() OVER (PARTITION BY file_id ORDER BY token) AS row_no FROM vault""")
def o114(spark, sf_dir):
    table = tokens(spark, sf_dir)
    known = table.where("pii_type = 'PERSON_NAME'").select("file_id", "token", "value")
    listing = vault.with_revealed(vault.vault_listing(table), known)
    numbered = skew.with_row_number(listing, ["token"], within="file_id")
    return numbered.select("file_id", "token", "revealed", "row_no")
