"""A mixed folder goes in; the same files come out in their own formats, without any value."""

import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape

import pytest

from veilspark.config import DetectConfig
from veilspark.plans import batch, folder
from veilspark.sinks import files as sink
from veilspark.sources import docx, pieces

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def document(*paragraphs, header=""):
    """Each paragraph a list of runs."""
    def p(runs):
        return "<w:p>" + "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' for r in runs) + "</w:p>"

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(map(p, paragraphs))}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {W}>{p([header])}</w:hdr>")
    return data.getvalue()


CSV = ('id,full_name,mobile,notes\r\n1,Asha Rao,9876543210,"said ""9876543210"", twice\nsee x9876543210y"\r\n'
       '2,"Vikram Nair",,plain\r\n\r\n3,Om,9123456780,"a,b",extra 9123456780')
JSON = ('{"person": {"phone": 9876543210, "full_name": "Asha \\"Rao\\"", "ok": true, "none": null},\n'
        '  "mails": ["asha@example.com", {"n": -1.50e3}], "9876543210": "key stays",\t"free": "ring 9876543210 \\u00e9"}')
SQL = ("-- people\nINSERT INTO people (full_name, mobile, note) VALUES ('Asha Rao', '9876543210', 'it''s; (9876543210)'),\n"
       "  ('Om', 9123456780, NULL);\nUPDATE people SET email = 'asha@example.com', n = 5 WHERE id = 1;\n")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "sub").mkdir()
    contents = {
        "people.csv": CSV.encode(), "sub/people.csv": b"a,b\nno,thing\n", "person.json": JSON.encode(),
        "dump.sql": SQL.encode(), "empty.csv": b"", "blank.csv": b"\n", "bad.json": b"{", "latin.csv": b"name\nJos\xe9\n",
        "old.doc": b"x", "scan.pdf": b"%PDF", "broken.docx": b"PK",
        "letter.docx": document(["Phone: 98", "7654", "3210 and ", "9876543210"], ["plain"], header="tel 9876543210"),
    }
    for name, content in contents.items():
        (root / name).write_bytes(content)
    out = tmp_path_factory.mktemp("out")
    result = folder.run(spark, str(root), str(out), "run", DetectConfig(recogniser="none"), user_id=7)
    return contents, out, result


def read(done, name):
    return (done[1] / "files" / name).read_bytes()


def test_same_names_and_no_other(done):
    contents, out, result = done
    written = {str(p.relative_to(out / "files")) for p in (out / "files").rglob("*") if p.is_file()}
    assert written == {"people.csv", "sub/people.csv", "person.json", "dump.sql", "empty.csv", "blank.csv", "letter.docx"}
    status = {r.file_id: (r.status, r.reason) for r in result.files.collect()}
    assert set(status) == set(contents)
    assert {f for f, (s, _) in status.items() if s == "completed"} == written
    assert status["old.doc"][1] == "Unsupported file type: doc" and status["bad.json"][1] == "not valid JSON"
    assert status["latin.csv"][1] == "not valid UTF-8" and "BadZipFile" in status["broken.docx"][1]


def test_formats_are_kept(spark, done):
    tokens = {(r.file_id, r.value): r.token for r in done[2].tokens.collect()}
    phone = tokens["people.csv", "9876543210"]
    text = read(done, "people.csv").decode()
    want = CSV.replace('"Vikram Nair"', "Vikram Nair")  # the token needs no quotes
    for value in sorted((v for f, v in tokens if f == "people.csv"), key=len, reverse=True):
        want = want.replace(value, tokens["people.csv", value])
    assert text == want and text.count(phone) == 3
    assert [len(r) for r in csv.reader(io.StringIO(text, newline=""))] == [
        len(r) for r in csv.reader(io.StringIO(CSV, newline=""))]
    assert read(done, "sub/people.csv") == b"a,b\nno,thing\n" and read(done, "empty.csv") == b"" and read(done, "blank.csv") == b"\n"

    phone, mail = tokens["person.json", "9876543210"], tokens["person.json", "asha@example.com"]
    masked, plain = json.loads(read(done, "person.json")), json.loads(JSON)
    name = tokens.get(("person.json", 'Asha "Rao"'), 'Asha "Rao"')
    plain["person"] |= {"phone": phone, "full_name": name}
    plain["mails"][0], plain["free"] = mail, f"ring {phone} é"
    assert masked == plain and b"-1.50e3" in read(done, "person.json") and b'"9876543210": "key stays"' in read(done, "person.json")

    phone = tokens["dump.sql", "9876543210"]
    want = SQL
    for value in sorted((v for f, v in tokens if f == "dump.sql"), key=len, reverse=True):
        want = want.replace(value, tokens["dump.sql", value])
    assert read(done, "dump.sql").decode() == want and f"it''s; ({phone})" in want

    phone = tokens["letter.docx", "9876543210"]
    with zipfile.ZipFile(io.BytesIO(read(done, "letter.docx"))) as z:
        assert z.namelist() == ["[Content_Types].xml", "word/document.xml", "word/header1.xml"]
        assert f"tel {phone}" in z.read("word/header1.xml").decode()
        assert z.read("word/document.xml").count(b"<w:b />") == 5
    units = docx.docx_units(spark.createDataFrame([("f", read(done, "letter.docx"))], "file_id string, content binary"))
    assert [r.text for r in units.orderBy("unit_no").collect()] == [f"Phone: {phone} and {phone}", "plain"]


def test_nothing_is_left(spark, done):
    _, out, result = done
    assert folder.folder_leaks(spark, f"{out}/files", result.tokens).collect() == []
    before = folder.folder_leaks(spark, str(out / "files"), result.tokens.selectExpr(
        "file_id", "token AS value", "token"))
    assert before.collect() == []  # tokens are not leaks
    again = pieces.units(pieces.read_folder(spark, f"{out}/files"))
    found = batch.protect(again, f"{out}/again", "again", DetectConfig(recogniser="none"), "label", None)
    kept = {r.value for r in found.detections.collect()}
    assert not kept & {"9876543210", "9123456780", "asha@example.com"}


def test_report_and_audit(done):
    contents, _, result = done
    reports = {r.file_id: r.total_pii_found for r in result.report.collect()}
    assert reports["sub/people.csv"] == reports["empty.csv"] == 0 and reports["person.json"] >= 2
    audit = [(r.action, json.loads(r.details)["file_id"]) for r in result.audit.collect()]
    assert len(audit) == len(set(audit))
    actions = {}
    for action, file_id in audit:
        actions.setdefault(file_id, []).append(action)
    assert sorted(actions["people.csv"]) == ["mask", "report", "upload"]
    assert sorted(actions["old.doc"]) == ["failure", "upload"] and set(actions) == set(contents)


def test_pieces_make_the_file(spark, done):
    """Unmasked pieces put together are the file, to the byte."""
    files = pieces.read_folder(spark, str(done[1] / "files"))
    rows = pieces.pieces(files).orderBy("file_id", "position").collect()
    made = {}
    for r in rows:
        made[r.file_id] = made.get(r.file_id, "") + r.lead + (r.raw or "")
    assert made and all(made[f].encode() == read(done, f) for f in made)


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, b"x"), ("a", 1, b"y"), ("b/../c", 0, None)], "name string, position int, content binary")
    sink.write_files(rows, str(tmp_path / "ok"))
    assert (tmp_path / "ok" / "a").read_bytes() == b"xy" and (tmp_path / "ok" / "b" / "c").read_bytes() == b""
    assert [p.name for p in (tmp_path / "ok").iterdir() if p.name.startswith("_")] in ([], ["_staged"])
    with pytest.raises(Exception):
        sink.write_files(rows.selectExpr("if(name = 'a', '..', name) AS name", "position", "content"), str(tmp_path / "no"))
    assert [p for p in (tmp_path / "no").rglob("*") if p.is_file()] == []


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"x\n1\n")
    result = folder.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), "r", DetectConfig(recogniser="none"))
    assert result.vault.count() == 0 and (tmp_path / "out" / "files" / "a.csv").read_bytes() == b"x\n1\n"
