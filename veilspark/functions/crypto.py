"""Keyed hash and AES, from Spark's own expressions.

The key travels to the tasks inside a function, never as a literal: plans, event logs and error
texts show a call of `vault_key` and nothing of the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DECRYPTION_ERROR

HMAC_BLOCK = 64


def hidden(secret: bytes) -> Column:
    """The bytes as a column whose plan text does not show them."""
    def vault_key(_):
        return secret

    return F.udf(vault_key, "binary")(F.lit(0))


def aes_key(key: str) -> bytes:
    """UTF-8 bytes of the key, padded with zero bytes or cut to 32."""
    return key.encode("utf-8").ljust(32, b"\0")[:32]


def hmac_hex(key: str, message: Column) -> Column:
    """HMAC-SHA256 as 64 hex digits: two nested `sha2` calls around constant pads."""
    raw = key.encode("utf-8")
    if len(raw) > HMAC_BLOCK:
        raw = hashlib.sha256(raw).digest()
    block = raw.ljust(HMAC_BLOCK, b"\0")
    inner = hidden(bytes(b ^ 0x36 for b in block))
    outer = hidden(bytes(b ^ 0x5C for b in block))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def encrypt(key: str, value: Column) -> Column:
    """AES-256-CBC, PKCS padding, random IV in front, base64."""
    return F.base64(F.aes_encrypt(value, hidden(aes_key(key)), F.lit("CBC"), F.lit("PKCS")))


def decrypt(key: str, ciphertext: Column) -> Column:
    """Inverse of `encrypt`; the query fails on a damaged value."""
    plain = F.aes_decrypt(F.unbase64(ciphertext), hidden(aes_key(key)), F.lit("CBC"), F.lit("PKCS"))
    return plain.cast("string")


def decrypt_or_mark(key: str, ciphertext: Column) -> Column:
    """Inverse of `encrypt`; a damaged value becomes the error marker."""
    raw = F.try_to_binary(ciphertext, F.lit("base64"))
    plain = F.try_aes_decrypt(raw, hidden(aes_key(key)), F.lit("CBC"), F.lit("PKCS"))
    valid = F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string"))
    return F.coalesce(valid, F.lit(DECRYPTION_ERROR))
