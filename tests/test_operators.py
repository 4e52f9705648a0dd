"""Vault, masking, skew joins, sources, the batch run, and the registry."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.config import DetectConfig, scratch_dir, secret_key
from veilspark.functions import crypto
from veilspark.operators import mask, risk, skew, vault
from veilspark.operators.detect import detect_rows
from veilspark.plans import batch
from veilspark.sources import sqldump, tables
from veilspark.streaming.arrivals import all_reports, process_arrivals, whole_vault

KEYS = ["file_id", "unit_id"]


@pytest.fixture(scope="module")
def units(spark):
    """Two thirds of all rows in one file, many of them equal."""
    return spark.range(300).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 0 ELSE id % 7 END AS file_id", "id AS unit_id",
        "CASE WHEN id % 2 = 0 THEN 'phone 9876543210 or mail a.b@mail.example' "
        "WHEN id % 5 = 0 THEN 'nothing here' ELSE concat('mobile: ', cast(6000000000 + id AS string)) END AS text")


@pytest.mark.parametrize("scope", ["spans", "file"])
def test_batch_run_masks_and_restores(spark, units, scope):
    out = scratch_dir(spark, "run")
    result = batch.run(units, out, "r1", scope=scope)
    masked = result.masked.select(F.col("file_id").cast("bigint").alias("file_id"), "unit_id", "masked")
    assert masked.count() == 300
    assert masked.where("masked rlike '[0-9]{10}|@'").isEmpty()
    assert mask.leaks(masked, result.tokens, KEYS).isEmpty()
    revealed = vault.reverse_tokens(result.vault, secret_key(spark))
    back = mask.detokenise(masked, revealed, KEYS).select("file_id", "unit_id", "restored")
    plain = units.select("file_id", "unit_id", "text")
    assert back.exceptAll(plain).isEmpty() and plain.exceptAll(back).isEmpty()
    # again: same tokens, no duplicates
    again = batch.run(units, out, "r1", scope=scope)
    assert again.vault.count() == result.tokens.count()
    assert again.report.agg(F.sum("total_pii_found")).first()[0] == result.detections.count()


def test_equal_units_under_one_id(spark):
    units = spark.range(50).selectExpr("1 AS file_id", "'same' AS unit_id", "'phone 9876543210 x' AS text")
    result = batch.run(units, scratch_dir(spark, "run"), "r1")
    rows = result.masked.collect()
    assert len(rows) == 50 and {r.masked.startswith("phone PHONE_") and r.masked.endswith(" x") for r in rows} == {True}


def test_stream_gives_the_same_as_a_batch(spark, units):
    source, out, state = (scratch_dir(spark, n) for n in ("source", "out", "state"))
    units.write.parquet(source)
    stream = spark.readStream.schema(units.schema).parquet(source)
    process_arrivals(stream, out, state).awaitTermination()
    masked = spark.read.parquet(f"{out}/masked")
    expected = batch.run(units, scratch_dir(spark, "run"), "r1").masked
    cols = [F.col("file_id").cast("bigint"), "unit_id", "masked"]
    assert masked.select(*cols).exceptAll(expected.select(*cols)).isEmpty()
    assert masked.count() == 300


def test_batches_of_one_file_add_up(spark):
    """3,000 values of one file in two batches: no token stands for two, one report."""
    parts = [spark.range(k * 1500, k * 1500 + 1500).selectExpr(
        "1 AS file_id", "id AS unit_id", "concat('mobile: ', cast(6000000000 + id * 7 AS string)) AS text")
        for k in (0, 1)]
    out = scratch_dir(spark, "run")
    masked = [batch.run(p, out, f"b{k}").masked for k, p in enumerate(parts)]
    report = all_reports(spark, out).collect()
    assert [(r.file_id, r.total_pii_found) for r in report] == [(1, 3000)]
    sealed = whole_vault(spark, out)
    assert sealed.count() == 3000
    back = mask.detokenise(masked[0].unionByName(masked[1]), vault.reverse_tokens(sealed, secret_key(spark)), KEYS)
    wrong = back.join(parts[0].unionByName(parts[1]), "unit_id").where("restored <> text")
    assert back.count() == 3000 and wrong.isEmpty()


def test_replacement_in_one_pass(spark):
    mapping = F.array(*[
        F.struct(F.lit(v).alias("value"), F.lit(t).alias("token"))
        for v, t in (("PHONE", "PERSON_A"), ("98765", "PHONE_B"), ("9876543210", "PHONE_C"), ("a.b\\E", "MAIL_D"), ("", "X"))])
    texts = {
        "name: PHONE 9876543210": "name: PERSON_A PHONE_C", "98765x": "PHONE_Bx", "": "", "axb": "axb",
        "\x01a.b\\Ea.b\\E": "\x01MAIL_DMAIL_D", "98765432109876543210": "PHONE_CPHONE_C", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", mask.replace_all(F.col("t"), mapping).alias("m")).collect()
    assert {r.t: r.m for r in got} == texts
    none = df.select(mask.replace_all(F.col("t"), F.expr(f"cast(array() AS {mask.MAPPING})")).alias("m"))
    assert [r.m for r in none.collect()] == list(texts)


def test_token_is_closed(spark):
    """Digits that follow a token in the text are not taken for a part of it."""
    units = spark.createDataFrame([(1, 1, "mobile: 9876543210"), (1, 2, "x98765432101 ref")], "file_id int, unit_id int, text string")
    result = batch.run(units, scratch_dir(spark, "run"), "r", scope="file")
    back = mask.detokenise(result.masked, vault.reverse_tokens(result.vault, secret_key(spark)), KEYS)
    assert result.masked.where("masked LIKE '%9876543210%'").isEmpty()
    assert {(r.unit_id, r.restored) for r in back.collect()} == {(1, "mobile: 9876543210"), (2, "x98765432101 ref")}


def test_lookup_join_with_hot_key_is_whole(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 500 END AS k", "id")
    lookup = batch.stage(rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2), "lookup")
    hot = lookup.where("n > 1000").count()
    got = skew.lookup_join(rows, lookup, ["k"], "n", ["v"])
    want = rows.join(lookup.select("k", "v"), "k")
    assert hot == 1 and got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 20_000


def test_row_numbers_without_one_task(spark):
    rows = spark.range(2_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 9 END AS f", "id * 7919 % 2000 AS x")
    got = skew.with_row_number(rows, ["x"], within="f").collect()
    for f in {r.f for r in got}:
        mine = sorted((r.x, r.row_no) for r in got if r.f == f)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    everything = sorted((r.x, r.row_no) for r in skew.with_row_number(rows.drop("f"), ["x"]).collect())
    assert [n for _, n in everything] == list(range(1, 2_001))


def test_keyed_hash_is_hmac(spark):
    for key in ("k", "k" * 100):
        got = spark.range(1).select(crypto.hmac_hex(key, F.lit("नाम x"))).first()[0]
        assert got == hmac.new(key.encode(), "नाम x".encode(), hashlib.sha256).hexdigest()


def test_encryption(spark):
    df = spark.createDataFrame([("hello",), ("नाम",), ("",)], "v string")
    sealed = df.withColumn("c", crypto.encrypt("key", F.col("v")))
    assert sealed.select(crypto.decrypt("key", F.col("c")) == F.col("v")).distinct().first()[0]
    wrong = sealed.select(crypto.decrypt_or_mark("key", F.lit("AAAA")).alias("x")).distinct().collect()
    assert [r.x for r in wrong] == ["[DECRYPTION_ERROR]"]


def test_key_is_required(spark):
    old = spark.conf.get("spark.veilspark.key")
    spark.conf.unset("spark.veilspark.key")
    try:
        with pytest.raises(ValueError):
            secret_key(spark)
    finally:
        spark.conf.set("spark.veilspark.key", old)


@pytest.mark.parametrize("types, total, score, status", [
    ([], 0, 0.0, "compliant"),
    (["PERSON_NAME"], 1, 2.2, "low_risk"),
    (["EMAIL_ADDRESS"] * 3, 3, 5.3, "medium_risk"),
    (["AADHAAR"], 1, 8.2, "high_risk"),
    (["AADHAAR", "PAN", "PHONE_NUMBER", "ADDRESS"] * 3, 12, 8.9, "high_risk"),
    (["PAN", "EMAIL_ADDRESS"] * 999, 1998, 9.2, "critical"),  # 9.25 rounds to even
])
def test_risk(spark, types, total, score, status):
    found = spark.createDataFrame([(1, t) for t in types], "file_id int, pii_type string")
    files = spark.createDataFrame([(1,)], "file_id int")
    r = risk.reports(found, files).first()
    assert (r.total_pii_found, r.risk_score, r.compliance_status) == (total, score, status)


def test_insert_tuples_of_any_depth(spark):
    sql = "insert into t values ('a', f(g(h(i('x'))))), ('b; c', ''), (\"d\")"
    df = spark.createDataFrame([(1, sql)], "id int, statement string")
    got = [r.value for r in sqldump.insert_literals(df, ["id"]).orderBy("row_no", "pos").collect()]
    assert got == ["a", "f(g(h(i('x'))))", "b; c", "d"]


def test_statements_split_outside_quotes(spark):
    df = spark.createDataFrame([("a 'x;y' b; c \"p;q\";; d it's",)], "t string")
    got = [r.statement for r in sqldump.split_statements(df, "t").collect()]
    assert got == ["a 'x;y' b", "c \"p;q\"", "d it's"]


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a.b,c\n"x, ""y""\nz",\n 1 ,NA\n')
    rows = tables.read_csv(spark, str(path)).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(" 1 ", "NA", []), ('x, "y"\nz', "", [])]


def test_confidence_limit(spark):
    df = spark.createDataFrame([(1, "phone 9876543210 pan ABCDE1234F")], "i int, text string")
    got = detect_rows(df, ["i"], DetectConfig(min_confidence=0.9)).collect()
    assert [r.pii_type for r in got] == ["PAN"]


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    numbers = {int(k[1:].split("_")[0]) for k in queries if k[0] == "o" and k[1].isdigit()}
    missing = set(range(1, 115)) - numbers
    assert not missing, missing
    df = entry.entry(spark)
    assert "risk_score" in df.columns and df.count() > 0


def test_documents_are_checked_with_the_recogniser(spark, sf_dir, monkeypatch):
    import checks.resolve

    rows = [(1, 1, "yesterday the customer Ravi Kumar, a resident, moved from his address to Mumbai")]
    monkeypatch.setattr(checks.resolve, "units", lambda *_: spark.createDataFrame(
        rows, "unit_id bigint, file_id bigint, text string"))
    found = checks.QUERIES["o62_detect_documents"](spark, sf_dir).collect()
    assert "Ravi Kumar" in {r.value for r in found if r.pii_type == "PERSON_NAME"}
