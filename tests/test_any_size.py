"""Folders whose files are larger than a value, a VARIANT or a task's memory: none is left out, and no
row holds one."""

import io
import random
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from veilspark.sources import catalog, docx, opened, pieces

NS = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" '
      'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"')


def test_no_file_is_left_out_for_its_size(spark, tmp_path, monkeypatch):
    (tmp_path / "small.csv").write_bytes(b"a\n1\n")
    (tmp_path / "large.csv").write_bytes(b"a\n" + b"12345\n" * 100)
    monkeypatch.setattr(catalog, "MAX_BYTES", 50)
    assert catalog.read_files(spark, str(tmp_path)).count() == 2
    files = pieces.read_folder(spark, str(tmp_path))
    assert "content" not in files.columns  # tasks open them
    assert {r.file_id: r.n for r in pieces.units(files).groupBy("file_id").agg(F.count("*").alias("n")).collect()} == {
        "small.csv": 1, "large.csv": 100}


def test_json_larger_than_a_variant_is_valid(spark, tmp_path):
    """140 MB in one array; what stands behind an array makes it no JSON text."""
    one = '{"name": "' + "x" * 1_000_000 + '", "phone": 9876543210}'
    (tmp_path / "large.json").write_text("[" + ", ".join([one] * 140) + "]")
    (tmp_path / "torn.json").write_text("[" + ", ".join([one] * 3) + "] x")
    (tmp_path / "twice.json").write_text('[{"a": 1, "a": 2}]')
    files = pieces.read_folder(spark, str(tmp_path))
    assert {r.file_id: r.reason for r in pieces.rejects(files).collect()} == {
        "torn.json": "not valid JSON", "twice.json": "not valid JSON"}


def paragraph(text, size=6):
    return "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(text[k:k + size])}</w:t></w:r>' for k in range(0, len(text), size)) + "</w:p>"


def package(body, **parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", '<?xml version="1.0" encoding="UTF-8"?>\n<!-- <w:x> -->'
                   f'<w:document {NS} mc:Ignorable="w"><w:background/><w:body>{body}<w:sectPr/></w:body></w:document>\n')
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
        z.writestr("word/media/a.bin", bytes(range(256)) * 8000)
    return data.getvalue()


def test_large_packages_are_cut(spark, tmp_path):
    rng = random.Random(4)
    values = {f"{rng.randrange(10**9, 10**10)}": f"PHONE_{k}" for k in range(300)}
    texts = [f"row {k} é & <{rng.choice(list(values))}> {'' if k % 3 else rng.choice(list(values))}\t." for k in range(9000)]
    body = "".join(
        f"<w:tbl><w:tr><w:tc>{paragraph(t)}</w:tc><w:tc>{paragraph('two')}{paragraph('lines')}</w:tc></w:tr></w:tbl>" if k % 40 == 5 else
        "\n " + paragraph(t) if k % 7 else paragraph(t) + "<w:p/>" for k, t in enumerate(texts))
    phone = next(iter(values))
    whole = {"large.docx": package(body, header1=f"<w:hdr {NS}>{paragraph('tel ' + phone)}</w:hdr>"),
             "small.docx": package(paragraph(f"call {phone}")), "plain.docx": package(paragraph("nothing here")),
             "bad.docx": package(body[:-20]), "none.docx": b"PK"}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    files = pieces.read_folder(spark, str(tmp_path))
    packages = docx.cut_packages(files)
    cut = packages.where("file_id = 'large.docx' AND kind = 'body'")
    assert cut.count() > 5 and packages.agg(F.max(F.length("data"))).first()[0] < 3 * docx.FRAGMENT + opened.PIECE

    given = pd.DataFrame({"file_id": list(whole), "content": list(whole.values())})
    want = pd.concat(docx._reader()([given]))
    got = docx.docx_units(files).collect()
    assert sorted((r.file_id, r.unit_no, r.text) for r in got if r.error is None) == sorted(
        want[want.error.isna()][["file_id", "unit_no", "text"]].itertuples(index=False, name=None))
    assert {r.file_id for r in got if r.error} == {"bad.docx", "none.docx"} == set(want[want.error.notna()].file_id)

    texts = docx.package_texts(packages)
    tokens = spark.createDataFrame(list(values.items()), "value string, token string")
    hits = texts.join(tokens, F.contains("text", "value")).select("file_id", "entry", "seq", "value", "token")
    rows = docx.rewrite_packages(files, packages, hits).orderBy("name", "position").collect()
    made = {}
    for r in rows:
        made[r.name] = made.get(r.name, b"") + bytes(r.content)
    mapping = [{"value": v, "token": t} for v, t in values.items()]
    old = pd.concat(docx._rewriter()([given[:2].assign(mapping=[mapping] * 2)])).set_index("file_id").content
    for name in ("large.docx", "small.docx"):
        both = pd.concat(docx._reader()([pd.DataFrame({"file_id": ["a", "b"], "content": [made[name], old[name]]})]))
        assert list(both[both.file_id == "a"].text) == list(both[both.file_id == "b"].text) and not both.error.any()
        with zipfile.ZipFile(io.BytesIO(made[name])) as a, zipfile.ZipFile(io.BytesIO(old[name])) as b:
            assert a.testzip() is None and a.namelist() == b.namelist() and a.read("word/media/a.bin") == b.read("word/media/a.bin")
    with zipfile.ZipFile(io.BytesIO(made["large.docx"])) as z:
        assert values[phone] in z.read("word/header1.xml").decode() and b'mc:Ignorable="w"' in z.read("word/document.xml")
    assert made["plain.docx"] == whole["plain.docx"]  # no value, so to the byte


def test_a_folder_has_the_same_names_however_it_is_spelled(spark, tmp_path):
    (tmp_path / "a b" / "100%").mkdir(parents=True)
    (tmp_path / "a b" / "100%" / "c#.csv").write_bytes(b"x\n1\n")
    (tmp_path / "a b" / "empty.csv").write_bytes(b"")
    for path in (f"{tmp_path}/a b", f"{tmp_path}/a b/", f"file:{tmp_path}/a b", f"file://{tmp_path}/a b/"):
        files = pieces.read_folder(spark, path)
        assert {r.file_id: r.length for r in files.collect()} == {"100%/c#.csv": 4, "empty.csv": 0}, path
        assert {r.file_id for r in opened.fingerprints(files).collect()} == {"100%/c#.csv", "empty.csv"}, path


def test_large_rows_are_written_in_small_groups(spark):
    """What a task reads at once is a row group, however large its rows are."""
    import glob

    import pyarrow.parquet as pq

    from veilspark.operators.skew import LARGE_ROWS, written

    rows = spark.range(0, 300, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).select("id", F.expr(
        "array_join(transform(sequence(1, 5000), k -> sha2(concat(h, k), 256)), '')").alias("text"))
    table = written(rows, "large-rows")
    (file,) = glob.glob(table.inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 300 and max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 32 << 20
    assert table.where("length(text) = 320000").count() == 300
    # what compresses well is as large again when it is read
    same = spark.range(0, 300, 1, 1).selectExpr("repeat(concat('<w:t>', id % 7, '</w:t>'), 20000) AS text")
    (file,) = glob.glob(written(same, "large-rows", LARGE_ROWS).inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 300 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= LARGE_ROWS
