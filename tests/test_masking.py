"""Values of a file are found in its texts, wherever they stand, and none is left."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.config import DetectConfig
from veilspark.operators import mask, skew, winnow
from veilspark.plans import batch
from veilspark.sinks.writers import control_table


def word(rng, n):
    return "".join(rng.choices("ab1é🙂 ", k=n))


@pytest.fixture(scope="module")
def corpus():
    """Texts and values over a small alphabet, so that values overlap and repeat."""
    rng = random.Random(1)
    values = {f: {word(rng, rng.randint(1, 25)) for _ in range(200)} | {"a" * 14, "a" * 11} for f in ("f", "g", None)}
    texts = []
    for k in range(300):
        file, text = rng.choice(["f", "g", None, "h"]), word(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 4) if file in values else 0):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(sorted(values[file])) + text[at:]
        texts.append((file, k if k % 17 else None, text if k % 13 else None))
    texts += [("f", 9998, "a" * 40), ("f", 9999, "")] + [("f", 5000, f"x {'a' * 14} y")] * 30
    return texts, [(f, v, f"T{i}") for f in values for i, v in enumerate(sorted(values[f]))]


def frames(spark, corpus):
    texts, values = corpus
    return (spark.createDataFrame(texts, "file_id string, unit_id int, text string"),
            spark.createDataFrame(values, "file_id string, value string, token string"))


@pytest.mark.parametrize("piece", [winnow.PIECE, 50])
def test_every_value_is_found_once(spark, corpus, monkeypatch, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    texts, values = frames(spark, corpus)
    got = [tuple(r) for r in winnow.find_values(texts, values, ["file_id", "unit_id"], cols=["token"]).collect()]
    want = {(f, u, v, t) for f, u, text in corpus[0] for g, v, t in corpus[1]
            if f is not None and f == g and u is not None and text and v in text}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_no_values_no_texts(spark, corpus):
    texts, values = frames(spark, corpus)
    assert winnow.find_values(texts, values.limit(0), ["file_id", "unit_id"]).collect() == []
    assert winnow.find_values(texts.limit(0), values, ["file_id", "unit_id"]).collect() == []


def test_few_places_of_a_text_are_sent(spark):
    """Minimisers are below a third of the characters; with the bit table only those of values."""
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=30_000))
    assert len(winnow.minimisers(text)) < len(text) / 3
    value = text[1000:1012]
    values = spark.createDataFrame([("f", value)], "file_id string, value string")
    anchored = winnow.anchors(values, "file_id")
    table = winnow.bit_table(anchored, winnow.LEAST_BITS)
    assert int(np.unpackbits(table).sum()) == 1
    texts = spark.createDataFrame([("f", 1, text), ("g", 1, text)], "file_id string, unit_id int, text string")
    sent = winnow.grams(texts, ["file_id", "unit_id"], "file_id", "text", [0], table, winnow.LEAST_BITS).collect()
    assert 1 <= len(sent) < 10
    assert winnow.minimisers(value)[0][1] in {r.gram for r in sent}


def test_few_places_are_tried_among_many_numbers(spark, monkeypatch):
    """With a value behind a fifth of all five digits, a text is still cut where values begin only."""
    rng = random.Random(4)
    numbers = ["".join(rng.choices("0123456789", k=10 + k % 8)) for k in range(20_000)]
    text = "".join(rng.choices("0123456789", k=3000)) + numbers[7]
    cut, tried = winnow._cut, []
    monkeypatch.setattr(winnow, "_cut", lambda *a: tried.append(cut(*a)) or tried[-1])
    values = spark.createDataFrame([("f", v) for v in numbers], "file_id string, value string")
    texts = spark.createDataFrame([("f", 1, text)], "file_id string, unit_id int, text string")
    found = [r.value for r in winnow.find_values(texts, values, ["file_id", "unit_id"]).collect()]
    assert numbers[7] in found and set(found) == {v for v in numbers if v in text}
    assert tried[0].count() <= 2 * len(found) + 5


@pytest.mark.parametrize("many", [0, 200])
def test_stretches_by_either_walk(spark, corpus, monkeypatch, many):
    monkeypatch.setattr(winnow, "MANY_HEADS", many)
    tried = [{"head": "abcabcabca", "lengths": [10, 12]}, {"head": "bcabcabcab", "lengths": [11]}]
    text = "abc" * 5
    want = [text[p : p + n] for p in (0, 3) for n in (10, 12)] + [text[p : p + 11] for p in (1, 4)]
    assert sorted(set(winnow._stretches(text, tried))) == sorted({w for w in want})
    monkeypatch.setattr(winnow, "HELD", 3)
    texts, values = frames(spark, corpus)
    got = {tuple(r) for r in winnow.find_values(texts, values, ["file_id", "unit_id"]).collect()}
    assert got == {(f, u, v) for f, u, t in corpus[0] for g, v, _ in corpus[1]
                   if f is not None and f == g and u is not None and t and v in t}


def test_replacement_leaves_no_value(spark, corpus, tmp_path):
    texts, values = frames(spark, corpus)
    masked = skew.written(mask.mask_by_file(texts, values, ["file_id", "unit_id"]), "masked")
    assert masked.count() == len(corpus[0])
    by_file = {}
    for f, v, t in corpus[1]:
        by_file.setdefault(f, []).append((v, t))
    for r in masked.where("file_id IN ('f', 'g') AND unit_id IS NOT NULL AND text IS NOT NULL").collect():
        left, at = [], 0
        while at < len(r.text):
            hit = max((v for v in by_file[r.file_id] if r.text.startswith(v[0], at)), key=lambda v: len(v[0]), default=None)
            left.append(hit[1] if hit else r.text[at])
            at += len(hit[0]) if hit else 1
        assert r.masked == "".join(left)
    plain = masked.where("file_id = 'h' OR file_id IS NULL OR unit_id IS NULL")
    assert plain.where("NOT (masked <=> text)").count() == 0


@pytest.mark.parametrize("small", [1, 800])
def test_lookup_join_with_hot_keys(spark, monkeypatch, small):
    """Hot keys are broadcast or, where their rows are large, spread; the rest is joined as usual."""
    monkeypatch.setattr(skew, "MAX_HOT_BYTES", small)
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 9000, 0).when(F.col("id") < 12_000, F.col("id") % 50).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("n"))
    rows = skew.written(rows, "rows")
    lookup = spark.range(15_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    got = skew.counted_join(rows, lookup, ["k"], ["v"])
    assert got.count() == 15_000 and got.where("v != concat('v', k)").count() == 0
    left = skew.counted_join(rows, lookup, ["k"], ["v"], "left")
    assert left.count() == 20_000 and left.where("v IS NULL").count() == 5_000


def test_runs_are_kept_apart_and_leave_nothing(spark, tmp_path):
    """Run ids that look like one number; a number that stands without context elsewhere in its file."""
    out, cfg = str(tmp_path / "out"), DetectConfig(recogniser="none")
    for run_id, phone in (("1", "9876543210"), ("01", "9123456780"), ("2026-01-05", "9012345678")):
        rows = [("f", 1, f"mobile: {phone}"), ("f", 2, f"x{phone}y"), ("f", 3, run_id)]
        result = batch.run(spark.createDataFrame(rows, "file_id string, unit_id int, text string"), out, run_id, cfg)
        texts = {r.unit_id: r.masked for r in result.masked.collect()}
        assert len(texts) == 3 and not any(phone in t for t in texts.values()) and texts[3] == run_id
        assert [r.total_pii_found for r in result.report.collect()] == [1]
        assert mask.leaks(result.masked, result.tokens, ["file_id", "unit_id"]).count() == 0
    runs = control_table(spark, f"{out}/masked").groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in runs} == {"1": 3, "01": 3, "2026-01-05": 3}


def test_a_mapping_is_prepared_once_for_all_texts_of_a_row(spark, monkeypatch):
    """Not for every column and leaf."""
    prepare, calls = mask.prepared, []
    monkeypatch.setattr(mask, "prepared", lambda m: calls.append(1) or prepare(m))
    row = ("Asha Rao", "call Asha Rao on 98765", 98765, None, [("Asha", "P_1"), ("Asha Rao", "P_2"), ("98765", "T_1"), ("", "no")])
    df = spark.createDataFrame([row, (*row[:4], None)], f"a string, b string, n bigint, z string, m {mask.MAPPING}")
    got = [tuple(r) for r in mask.mask_columns(df, ["a", "b", "z"], "m").select("a", "b", "z").collect()]
    assert got == [("P_2", "call P_2 on T_1", None), (row[0], row[1], None)]
    nested = df.select("m", F.struct("a", F.array("b", "z").alias("l"), F.struct("n").alias("s")).alias("d"))
    out = nested.select(mask.mask_nested(F.col("d"), nested.schema["d"].dataType, F.col("m")).alias("d")).collect()
    assert [(r.d.a, r.d.l, r.d.s.n) for r in out] == [("P_2", ["call P_2 on T_1", None], "T_1"), (row[0], [row[1], None], "98765")]
    assert len(calls) == 2
