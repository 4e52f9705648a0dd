"""The vault key shows in no plan."""

import base64
import hashlib

from pyspark.sql import functions as F

from veilspark.config import secret_key
from veilspark.operators import vault


def test_no_plan_shows_the_key(spark):
    key = "a key of the tests, not short at all"
    values = spark.createDataFrame([("f", "9876543210", "PHONE_NUMBER", 1)], "file_id string, value string, pii_type string, n_found long")
    tokens = vault.assign_tokens(values, key)
    sealed = vault.encrypt_values(tokens, key)
    tables = [tokens, vault.assign_tokens(values, key, digits=5), sealed, vault.reverse_tokens(sealed, key, "f")]
    texts = [t._jdf.queryExecution().toString() + t._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")) for t in tables]
    raw = key.encode()
    forms = [raw, raw[:32], raw.ljust(64, b"\0"), bytes(b ^ 0x36 for b in raw.ljust(64, b"\0")),
             bytes(b ^ 0x5C for b in raw.ljust(64, b"\0")), hashlib.sha256(raw).digest()]
    for text in texts:
        assert "vault_key" in text
        for form in forms:
            for shown in (form[:16].hex(), base64.b64encode(form[:15]).decode(), form[:16].decode("latin-1")):
                assert shown.lower() not in text.lower()
    back = vault.reverse_tokens(sealed, key).select("value").first()[0]
    assert back == "9876543210" and secret_key(spark)
    assert tokens.first().token == vault.assign_tokens(values.withColumn("n_found", F.lit(2)), key).first().token
