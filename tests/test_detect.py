"""Detection: single texts with known results, and agreement with plain regex search."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark import constants as C
from veilspark.config import DetectConfig
from veilspark.functions.spans import blocks, locate, searchable
from veilspark.operators import fields, patterns
from veilspark.operators.detect import add_detections, detect_rows

ROW = (
    "id: 7 | full_name: Asha Rao | mobile: 9876501234 | email: asha.rao@mail.example | "
    "aadhaar: 2345 6789 0123 | pan: ABCPK1234Z | dob: 1990-05-14 | address: 4 Lake Road, Ward 3 | "
    "city: Chennai | pincode: 600001 | bank_account: 9876001234560001 | ifsc: HDFC0001234 | "
    "upi_id: asha.rao@okbank | voter_id: MH/01/123/456789 | passport: P1234567 | amount: 15000.00"
)

SINGLE = [
    ("Aadhaar: 1234 5678 9012", [("AADHAAR", "1234 5678 9012", 0.95)]),
    ("Aadhaar 1234-5678-9012", [("AADHAAR", "1234-5678-9012", 0.95)]),
    ("Aadhaar 1234\t5678\t9012", []),
    ("PAN card: ABCDE1234F", [("PAN", "ABCDE1234F", 0.95)]),
    ("Mobile: 9876543210", [("PHONE_NUMBER", "9876543210", 0.95)]),
    ("Bank account: 1234567890123456", [("BANK_ACCOUNT", "1234567890123456", 0.80)]),
    ("Passport: Z1234567", [("PASSPORT", "Z1234567", 0.80)]),
    ("Email: a.person@company.com", [("EMAIL_ADDRESS", "a.person@company.com", 0.95)]),
    ("Random 9876543210", []),
    ("", []),
    ("   \n\t  ", []),
    (None, []),
    ("phone of 9876543210", [("PHONE_NUMBER", "9876543210", 0.85)]),
    ("Please call me: x 9876543210 phone", []),
    ("card 1234 5678 9012 3456", [("AADHAAR", "1234 5678 9012", 0.95)]),
    ("John Doe visited Mumbai", []),
    ("Name: A Bob, Aadhaar: 1234 5678 9012", [("PERSON_NAME", "A Bob, Aadhaar: 1234 5678 9012", 0.95)]),
    ("😀 phone 9876543210", [("PHONE_NUMBER", "9876543210", 0.85)]),
    ("phone é9876543210", []),
    ("फोन phone की9876543210", [("PHONE_NUMBER", "9876543210", 0.85)]),
    ("phone \x01 9876543210 \x01", [("PHONE_NUMBER", "9876543210", 0.85)]),
    ("name: A\x01sha Rao", [("PERSON_NAME", "A\x01sha Rao", 0.95)]),
]
DIFFERENT = [
    # text, relaxed, strict
    ("phone +919876543210", [("PHONE_NUMBER", "+919876543210", 0.85)], [("AADHAAR", "919876543210", 0.95)]),
    ("phone +91 9876543210", [("PHONE_NUMBER", "+91 9876543210", 0.85)], [("PHONE_NUMBER", "9876543210", 0.85)]),
    ("account: 9876543210", [("BANK_ACCOUNT", "9876543210", 0.80)], []),
    ("upi_id: 9876543210@ybl", [("UPI_ID", "9876543210@ybl", 0.95)], []),
    ("Contact: John Doe", [], [("PHONE_NUMBER", "John Doe", 0.85)]),
]


def found(spark, texts, cfg):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in detect_rows(df, ["i"], cfg).orderBy("i", "start").collect():
        text = texts[r.i]
        assert text[r.start:r.end] == r.value
        out[r.i].append((r.pii_type, r.value, round(r.confidence, 2)))
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("strict", [False, True])
def test_single_texts(spark, strict):
    got = found(spark, [t for t, _ in SINGLE], DetectConfig(strict=strict))
    assert got == [want for _, want in SINGLE]


def test_texts_that_depend_on_strict(spark):
    texts = [t for t, _, _ in DIFFERENT]
    assert found(spark, texts, DetectConfig()) == [r for _, r, _ in DIFFERENT]
    assert found(spark, texts, DetectConfig(strict=True)) == [s for _, _, s in DIFFERENT]


def test_row_has_one_of_each_type(spark):
    (got,) = found(spark, [ROW], DetectConfig())
    assert sorted(t for t, _, _ in got) == sorted(C.PII_TYPES)
    assert ("PERSON_NAME", "Asha Rao", 0.95) in got
    assert ("ADDRESS", "4 Lake Road, Ward 3", 0.95) in got


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(200).select("id", F.concat(F.lit(ROW), F.col("id").cast("string")).alias("text"))
    a = detect_rows(df.repartition(1), ["id"])
    b = detect_rows(df.repartition(7), ["id"])
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == b.count()


def test_detection_is_one_narrow_native_pass(spark):
    df = detect_rows(spark.range(1).selectExpr("id", "'x' AS text"), ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_text_with_many_hits(spark):
    n = 20_000
    text = "phone " + " ".join(str(6_000_000_000 + i) for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    got = add_detections(df, DetectConfig(recogniser="none")).selectExpr("size(detections) AS n").first().n
    # only numbers within 120 characters of the word "phone" are supported
    assert 0 < got < 15


def test_long_text_where_every_hit_counts(spark):
    n = 5_000
    text = "\n".join(f"phone {6_000_000_000 + i}" for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    rows = detect_rows(df.withColumn("i", F.lit(1)), ["i"]).orderBy("start").collect()
    assert len(rows) == n and all(text[r.start:r.end] == r.value for r in rows)


def python_class_search(pattern, text):
    return [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text)]


# Pieces that meet at word boundaries, separators and other scripts.
PIECES = st.sampled_from([
    "1234", "5678", "9012", "9876543210", "123456789", " ", "-", "\t", "\n", "é", "की", "²", "_", ".", "@",
    "+91", "ABCDE", "F", "HDFC0", "A1B2C3", "ybl", "mail.com", "x", "/", "MH/01/123/456789", "P1234567", "😀", "१२३४", "\x01",
])
TEXTS = st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=20, max_size=20)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_spans_agree_with_unicode_search(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn(
        "t", F.expr(searchable("text")))
    for pii_type, pattern in C.PATTERNS.items():
        spans = locate("m")
        rows = df.withColumn("m", F.expr(patterns.find_pieces("t", pii_type))).select("i", F.expr(spans).alias("s"))
        got = {r.i: [(s.start, s.end, s.value) for s in r.s] for r in rows.collect()}
        want = {i: python_class_search(pattern, t) for i, t in enumerate(texts)}
        assert got == want, pii_type


LINES = st.lists(
    st.lists(st.sampled_from(["name", "full_name", ":", " ", " | ", "\n", "Asha", "x.y", "  ", "é", "\r", " ", ","]), max_size=14)
    .map("".join), min_size=20, max_size=20)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(LINES)
def test_pairs_agree_with_unicode_search(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn(
        "m", F.expr(fields.find_pairs("text", only_relevant=False)))
    rows = df.select("i", F.expr(fields.pair_spans(blocks("text"), "m", only_relevant=False)).alias("s")).collect()
    got = {r.i: [(s.label, s.value, s.start, s.end) for s in r.s] for r in rows}
    want = {}
    for i, t in enumerate(texts):
        found_pairs = []
        for m in re.finditer(C.PAIR_PATTERN, t, re.MULTILINE):
            value = m.group(2).strip()
            if len(value) >= 2:
                found_pairs.append((m.group(1).lower(), value, m.start(2), m.start(2) + len(value)))
        want[i] = found_pairs
    assert got == want
