"""The trained recogniser on rows it has not seen, and places from a table."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.config import DetectConfig
from veilspark.operators import tagger
from veilspark.operators.detect import detect_rows

from checks import names

SPANS = "array<struct<start:int,end:int,label:string>>"


LARGER = "/root/testdata/sf0.01"  # 1,500 rows


@pytest.fixture(scope="module")
def model(spark):
    rows = names.labelled(spark, LARGER)
    return tagger.fit(rows.where("NOT held_out")), rows.where("held_out").collect()


def f1(model, rows):
    hits = guessed = real = 0
    for r in rows:
        want = {(s["start"], s["end"], s["label"]) for s in r.spans}
        got = set(model(r.text))
        hits, guessed, real = hits + len(want & got), guessed + len(got), real + len(want)
    return 2 * hits / (guessed + real)


def test_f1_on_unseen_names(model):
    tool, rows = model
    assert len(rows) > 200 and f1(tool, rows) >= 0.95


def test_better_than_the_rule_of_thumb(spark, model):
    tool, rows = model
    df = spark.createDataFrame([(k, r.text) for k, r in enumerate(rows)], "id int, text string")
    found = detect_rows(df, ["id"], DetectConfig(structured=False)).where("method = 'ner' AND pii_type = 'PERSON_NAME'")
    want = {(k, s["start"], s["end"]) for k, r in enumerate(rows) for s in r.spans if s["label"] == "PERSON"}
    rule = {(r.id, r.start, r.end) for r in found.collect()}
    own = {(k, s, e) for k, r in enumerate(rows) for s, e, label in tool(r.text) if label == "PERSON"}
    assert len(own & want) / len(own | want) > len(rule & want) / len(rule | want)


def test_in_detection(spark, model):
    df = spark.createDataFrame([(1, "customer Zubin Mistry of Pune asked again, mobile: 9876543210"), (2, None), (3, "nothing here")], "id int, text string")
    found = detect_rows(df, ["id"], DetectConfig(ner_fn=model[0])).collect()
    assert {(r.id, r.pii_type, r.value) for r in found} >= {(1, "PERSON_NAME", "Zubin Mistry"), (1, "PHONE_NUMBER", "9876543210")}
    assert {r.id for r in found} == {1}


def test_the_same_rows_give_the_same_model(spark, sf_dir):
    rows = names.labelled(spark, sf_dir).where("NOT held_out")
    one, two = (tagger.fit(df, max_rows=60, epochs=2) for df in (rows, rows.orderBy(F.rand(1))))
    assert (one.weights == two.weights).all() and (one.moves == two.moves).all()
    empty = tagger.fit(rows.limit(0))
    assert empty("Asha Rao of Mumbai") == []


def test_places_of_a_table(spark):
    rng = random.Random(1)
    places = [f"Place{k} {rng.choice(['Nagar', 'Pur', 'Bagh'])}" for k in range(500)] + ["Nowhere", "St. Ives"]
    texts = [(k, f"delivery address in {rng.choice(places)}, and Nowhere else Place9999 Pur", "x") for k in range(300)] + [(300, None, "x"), (300, None, "y")]
    units = spark.createDataFrame(texts, "id int, text string, _name string")
    table = spark.createDataFrame([(p,) for p in [*places, None]], "name string")
    got = {r.id: {r.text[e["start"]:e["end"]] for e in r.entities} if r.text else set() for r in
           tagger.known_places(units, table, ["id"]).collect()}
    for k, text, _ in texts:
        assert got[k] == {p for p in places if text and (p + "," in text or p == "Nowhere")}
    cfg = DetectConfig(ner_col="entities")
    found = detect_rows(tagger.known_places(units, table, ["id"]), ["id"], cfg)
    assert found.where("value = 'Nowhere'").count() == 300


def test_all_rows_are_learnt_from(spark, monkeypatch):
    """Also beyond 20,000; copies of one text are dealt over the shards."""
    tables = {}
    monkeypatch.setattr(tagger, "written", lambda df, name, real=tagger.written: tables.setdefault(name, real(df, name)))
    rows = spark.range(20_500).selectExpr(
        "if(id < 12000, 'Terms apply', concat('row ', id)) AS text", "cast(array() AS array<struct<start:int,end:int,label:string>>) AS spans")
    model = tagger.fit(rows, epochs=0)
    assert not model.weights.any() and list(tables)[-1] == "tagger-rows"
    shards = [r["count"] for r in tables["tagger-rows"].groupBy("_shard").count().collect()]
    assert sum(shards) == 20_500 and len(shards) == 9 and max(shards) < 2 * 20_500 / 9
