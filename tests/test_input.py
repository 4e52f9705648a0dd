"""What is read must end as a unit or as a reject."""

from pyspark.sql import functions as F

from veilspark.config import DetectConfig
from veilspark.operators import govern
from veilspark.operators.detect import detect_rows
from veilspark.plans import batch
from veilspark.sources import catalog, nested, sqldump


def files(spark, **contents):
    rows = [(name.replace("__", "."), c if isinstance(c, bytes) else c.encode()) for name, c in contents.items()]
    return spark.createDataFrame(rows, "name string, content binary")


def units(spark, **contents):
    found, rejected = catalog.mixed_units(files(spark, **contents))
    return (
        sorted((r.file_id, r.label or "", r.text) for r in found.collect()),
        sorted((r.file_id, r.reason) for r in rejected.collect()))


def test_csv_with_empty_and_extra_cells(spark):
    got, _ = units(spark, a__csv='id,name,phone\n,Asha Rao,9876543210\n2,,"1,2"\n3,Om\n4,Om,5,6\n,,\n')
    assert [t for *_, t in got] == sorted([
        "id:  | name: Asha Rao | phone: 9876543210", "id: 2 | name:  | phone: 1,2",
        "id: 3 | name: Om | phone: ", "id: 4 | name: Om | phone: 5 | extra: 6", "id:  | name:  | phone: "])


def test_folders_without_json_and_json_of_several_shapes(spark):
    got, rejected = units(spark, a__csv="n\nx\n")
    assert got == [("a.csv", "", "n: x")] and rejected == []
    got, rejected = units(
        spark, a__json='{"a": {"phone": "9876543210"}, "n": 12.50, "ok": true, "no": null}', b__json='{"a": "x"}',
        c__json='[{"pan": "P"}, 7, ["q"]]', d__json="{broken")
    assert got == sorted([
        ("a.json", "phone", "9876543210"), ("a.json", "n", "12.50"), ("a.json", "ok", "true"),
        ("b.json", "a", "x"), ("c.json", "pan", "P"), ("c.json", "", "7"), ("c.json", "", "q")])
    assert rejected == [("d.json", "not valid JSON")]


def test_one_bad_byte_rejects_one_file(spark):
    got, rejected = units(spark, a__csv=b"name\nJos\xe9\n", b__csv="name\nAsha\n", c__sql=b"\xff", d__xyz="?")
    assert got == [("b.csv", "", "name: Asha")]
    assert rejected == [
        ("a.csv", "not valid UTF-8"), ("c.sql", "not valid UTF-8"), ("d.xyz", "Unsupported file type: xyz")]


def test_no_file_is_left_out_without_a_reason(spark, tmp_path):
    for name, size in (("a.csv", 3), ("b.exe", 3), ("c.json", 50)):
        (tmp_path / name).write_bytes(b"x" * size)
    read = catalog.read_files(spark, str(tmp_path))
    names = [r.original_filename for r in catalog.catalog_rows(read, 1).collect()]
    rejects = [r.reason for r in catalog.catalog_rejects(read).collect()]
    assert sorted(names) == ["a.csv", "c.json"] and rejects == ["Unsupported file type: exe"]
    big = catalog.oversized_files(spark, str(tmp_path), limit=20).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in big] == [("c.json", "larger than one value: 50 bytes")]


def test_null_and_repeated_ids_keep_their_rows(spark, tmp_path):
    rows = [
        ("f", 1, "mobile: 9876543210"), ("f", 1, "call mobile: 9123456780 now"), ("f", 1, "mobile: 9876543210"),
        (None, 2, "mobile: 9876543210"), ("f", None, "mobile: 9876543210"), ("f", 3, "nothing")]
    df = spark.createDataFrame(rows, "file_id string, unit_id int, text string")
    for scope in ("file", "spans"):
        cfg = DetectConfig(recogniser="none")
        masked = batch.run(df, str(tmp_path / scope), "r", cfg, scope=scope).masked.collect()
        texts = sorted(r.masked for r in masked)
        assert len(masked) == len(rows) and not any("9876543210" in t or "9123456780" in t for t in texts)
        assert texts.count("mobile: [PHONE_NUMBER]") == 2 and "nothing" in texts
        long = [t for t in texts if t.startswith("call")]
        assert len(long) == 1 and long[0].startswith("call mobile: PHONE") and long[0].endswith(" now")


def test_digests_show_repeated_rows_and_moved_times(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "b"), ("y", "b")], "g string, v string")
    prints = [r.fingerprint for r in catalog.group_fingerprint(df, "g", ["v"]).collect()]
    assert len(set(prints)) == 2
    event = "SELECT 1 AS id, 2 AS user_id, 'a' AS action, 'file' AS resource_type, 3 AS resource_id, NULL AS ip_address"
    one, two = (
        govern.audit_rows(spark.sql(event).withColumn("created_at", F.lit(t).cast("timestamp")), []).first().row_digest
        for t in ("2024-01-01 00:00:00", "2024-01-01 00:00:01"))
    assert one != two


def test_dump_with_breaks_in_literals(spark, tmp_path):
    """Literals that hold the separator stay whole, next to files that need no care."""
    (tmp_path / "a.sql").write_text(
        "INSERT INTO t VALUES ('one');\nINSERT INTO t VALUES ('x;\ny;\n9876543211', \"it's;\nz\");\n"
        "UPDATE t SET a = 'p;\nq';INSERT INTO t VALUES ('two');\n")
    (tmp_path / "b.sql").write_text("INSERT INTO t VALUES ('three');\nINSERT INTO t VALUES ('it''s');\n")
    (tmp_path / "c.sql").write_text("")
    got = {(r.file_id, r.statement) for r in sqldump.read_dump(spark, str(tmp_path)).collect()}
    whole = {(r.file_id, r.statement) for r in sqldump.read_dump(spark, str(tmp_path), True).collect()}
    assert got == whole and len(got) == 6
    values = [r.value for r in sqldump.literals(sqldump.read_dump(spark, str(tmp_path)), ["file_id"]).collect()]
    assert "x;\ny;\n9876543211" in values


def test_labels_in_the_text_go_before_the_column(spark):
    """The notes cell has labels of its own; rows without a label are read as rows."""
    row = "full_name: asha rao | address: 4 Lake Road, Ward 3 | mobile: 9876543210"
    cells = [(1, "notes", "phone: 9876543210 | name: Asha Rao"), (2, None, row), (3, "phone", "at 12:30 9876543210"),
             (4, "full_name", "asha rao"), (5, "notes", "9876543210"), (6, None, None), (7, "", row)]
    df = spark.createDataFrame(cells, "id int, label string, text string")
    got = {(r.id, r.pii_type, r.value) for r in detect_rows(df, ["id"], label="label").collect()}
    plain = {(r.id, r.pii_type, r.value) for r in detect_rows(df.where("id IN (2, 7)"), ["id"]).collect()}
    assert {g for g in got if g[0] in (2, 7)} == plain and len(plain) == 6
    assert got - plain == {(1, "PHONE_NUMBER", "9876543210"), (1, "PERSON_NAME", "Asha Rao"),
                           (3, "PHONE_NUMBER", "9876543210"), (4, "PERSON_NAME", "asha rao")}


def test_json_files_over_several_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "a": [1,\n 2]\n}\n')
    (tmp_path / "b.json").write_text('[{"b":\n null}]')
    read = nested.read_variant(spark, str(tmp_path), whole_files=True)
    got = {r.file_id: r.j for r in read.select("file_id", F.to_json("content").alias("j")).collect()}
    assert got == {"a.json": '{"a":[1,2]}', "b.json": '[{"b":null}]'}
