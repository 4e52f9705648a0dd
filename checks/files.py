"""Sources and sinks: files are written by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.config import scratch_dir
from veilspark.operators.govern import by_id
from veilspark.plans.batch import spread
from veilspark.sinks import files as sink
from veilspark.sinks import writers
from veilspark.sources import catalog, docx, nested, sqldump, tables

from .data import COLUMNS, NOTES, PEOPLE, RENDERED, ctes, derive
from .registry import check

# -- CSV ------------------------------------------------------------------------------

# Cells with commas, quotes, line breaks, outer blanks, and empty ones.
_CELLS = f"""
SELECT CAST(unit_id AS STRING) AS id, text AS `location.note`, CASE WHEN unit_id % 3 = 0 THEN '' ELSE concat(' "q", ', CAST(unit_id AS STRING), ' ') END AS quoted
FROM ({NOTES}) n"""
_CELLS_SQL = _CELLS.replace("`", '"')


@check("o1_csv_scan", ctes(t=_CELLS_SQL) + 'SELECT * FROM t')
def o1(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    writers.write_csv(derive(spark, sf_dir, _CELLS), path)
    return tables.read_csv(spark, path, extra=None).drop("file_id")


_FLAT = f"SELECT CAST(c_custkey AS STRING) AS id, {', '.join(COLUMNS)} FROM ({PEOPLE}) p"


@check("o1_csv_scan_splittable", ctes(t=_FLAT) + "SELECT * FROM t")
def o1_flat(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    writers.write_csv(derive(spark, sf_dir, _FLAT), path)
    return tables.read_csv(spark, path, extra=None).drop("file_id")


# Records with cells beyond the header's width, with too few, and with breaks in a surplus cell.
_RAGGED = f"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat(full_name, ',', mobile)
  WHEN 1 THEN full_name WHEN 2 THEN concat(full_name, ',', mobile, ',', email, ',"', address, '"')
  ELSE concat('"', full_name, '",,"', mobile, chr(10), '""x""', '"') END AS line
FROM ({PEOPLE}) p"""


@check("o1_ragged_rows", ctes(p=PEOPLE) + """
SELECT full_name AS name, CASE WHEN c_custkey % 4 IN (0, 2) THEN mobile ELSE '' END AS phone,
  CASE c_custkey % 4 WHEN 2 THEN concat(email, '|', address) WHEN 3 THEN concat(mobile, chr(10), '"x"') ELSE '' END AS extra FROM p""")
def o1_ragged(spark, sf_dir):
    """No cell is lost."""
    path = scratch_dir(spark, "ragged")
    lines = derive(spark, sf_dir, _RAGGED).select(
        F.lit("f.csv").alias("name"), F.col("c_custkey").alias("position"), F.concat("line", F.lit("\n")).alias("line"))
    head = spark.range(1).select(F.lit("f.csv").alias("name"), F.lit(-1).cast("bigint").alias("position"),
                                 F.lit("name,phone\n").alias("line"))
    rows = head.unionByName(lines)
    sink.write_files(rows.select("name", "position", F.encode("line", "UTF-8").alias("content")), path)
    return tables.read_csv(spark, path).select("name", "phone", F.array_join("extra", "|").alias("extra"))


@check("o17_sanitised_csv", ctes(t=_CELLS_SQL) + """
SELECT id, replace("location.note", 'Rao', 'PERSON_1') AS "location.note", quoted FROM t""")
def o17(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    df = derive(spark, sf_dir, _CELLS)
    masked = df.withColumn("location.note", F.replace("`location.note`", F.lit("Rao"), F.lit("PERSON_1")))
    writers.write_csv(masked, path)
    return tables.read_csv(spark, path, extra=None).drop("file_id")


@check("o10_row_rendering", ctes(p=PEOPLE) + f"SELECT c_custkey, {RENDERED} AS text FROM p")
def o10(spark, sf_dir):
    return derive(spark, sf_dir, PEOPLE).select("c_custkey", tables.render_row(COLUMNS).alias("text"))


# -- JSON -----------------------------------------------------------------------------

_NESTED = """
struct(c_custkey AS id, full_name, struct(mobile, array(email, upi_id) AS mails) AS contact,
  array(struct('home' AS kind, address), struct('work' AS kind, cast(null AS string) AS address)) AS places) AS doc"""
_LEAVES_SQL = ctes(p=PEOPLE) + """
SELECT c_custkey, 'id' AS path, 'id' AS label, CAST(c_custkey AS STRING) AS text, false AS is_string FROM p
UNION ALL SELECT c_custkey, 'full_name', 'full_name', full_name, true FROM p
UNION ALL SELECT c_custkey, 'contact.mobile', 'mobile', mobile, true FROM p
UNION ALL SELECT c_custkey, 'contact.mails[]', 'mails', email, true FROM p
UNION ALL SELECT c_custkey, 'contact.mails[]', 'mails', upi_id, true FROM p
UNION ALL SELECT c_custkey, 'places[].kind', 'kind', 'home', true FROM p
UNION ALL SELECT c_custkey, 'places[].kind', 'kind', 'work', true FROM p
UNION ALL SELECT c_custkey, 'places[].address', 'address', address, true FROM p"""


def _docs(spark, sf_dir):
    return derive(spark, sf_dir, PEOPLE).selectExpr("c_custkey", _NESTED)


@check("o2_json_scan", _LEAVES_SQL)
def o2(spark, sf_dir):
    path = scratch_dir(spark, "json")
    writers.write_json(_docs(spark, sf_dir), path)
    df = nested.read_json(spark, path)
    return nested.leaf_rows(df, "doc", ["c_custkey"])


@check("o2_json_variant_scan", _LEAVES_SQL)
def o2_variant(spark, sf_dir):
    """JSON texts of unknown structure as VARIANT; nulls inside give no leaf."""
    texts = _docs(spark, sf_dir).select("c_custkey", F.to_json("doc").alias("j"))
    parsed = texts.select("c_custkey", F.parse_json("j").alias("doc"))
    return nested.leaf_rows(nested.typed_variant(parsed, "doc"), "doc", ["c_custkey"])


# Values of three shapes that no one schema fits.
_SHAPES = """
CASE c_custkey % 3 WHEN 0 THEN to_json(named_struct('person', named_struct('phone', mobile, 'n', c_custkey)))
  WHEN 1 THEN to_json(named_struct('person', full_name)) ELSE concat('[', c_custkey, ',', to_json(array(named_struct('pan', pan))), ', null, true]') END"""


@check("o2_mixed_shapes", ctes(p=PEOPLE) + """
SELECT c_custkey, 'person.phone' AS path, 'phone' AS label, mobile AS text, true AS is_string FROM p WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'person.n', 'n', CAST(c_custkey AS STRING), false FROM p WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'person', 'person', full_name, true FROM p WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, '[]', '', CAST(c_custkey AS STRING), false FROM p WHERE c_custkey % 3 = 2
UNION ALL SELECT c_custkey, '[][].pan', 'pan', pan, true FROM p WHERE c_custkey % 3 = 2
UNION ALL SELECT c_custkey, '[]', '', 'true', false FROM p WHERE c_custkey % 3 = 2""")
def o2_shapes(spark, sf_dir):
    docs = derive(spark, sf_dir, PEOPLE).select("c_custkey", F.parse_json(F.expr(_SHAPES)).alias("doc"))
    return nested.variant_leaves(docs, "doc", ["c_custkey"])


@check("o11_json_rendering", ctes(p=PEOPLE) + """
SELECT c_custkey, concat('{', chr(10), '  "full_name" : "', full_name, '",', chr(10), '  "mobile" : "', mobile, '"', chr(10), '}') AS text FROM p""")
def o11(spark, sf_dir):
    rendered = nested.render_json(F.struct("full_name", "mobile"))
    return derive(spark, sf_dir, PEOPLE).select("c_custkey", rendered.alias("text"))


@check("o18_sanitised_json", ctes(p=PEOPLE) + """
SELECT c_custkey, replace(full_name, 'Rao', 'PERSON_1') AS name, mobile, email AS mail, c_custkey AS id FROM p""")
def o18(spark, sf_dir):
    path = scratch_dir(spark, "json")
    docs = _docs(spark, sf_dir).withColumn("doc", F.col("doc").withField(
        "full_name", F.replace("doc.full_name", F.lit("Rao"), F.lit("PERSON_1"))))
    writers.write_json(docs, path)
    return nested.read_json(spark, path).selectExpr(
        "c_custkey", "doc.full_name AS name", "doc.contact.mobile", "doc.contact.mails[0] AS mail", "doc.id")


# -- SQL dumps --------------------------------------------------------------------------

# INSERT with two tuples (one nested call), UPDATE with and without WHERE, others.
_STATEMENTS = f"""
SELECT c_custkey AS stmt_id, CASE c_custkey % 5
  WHEN 0 THEN concat('INSERT INTO users (name, phone, n) VALUES (''', full_name, ''', ''', mobile, ''', 7), (''', email, ''', upper(trim(''x'')), '''')')
  WHEN 1 THEN concat('update users set name = ''', full_name, ''', address = ''', address, ''' where id = ', CAST(c_custkey AS STRING))
  WHEN 2 THEN concat('UPDATE users SET pan="', pan, '", note = ''a=b''')
  WHEN 3 THEN concat('insert into t values (', CAST(c_custkey AS STRING), ', ''', replace(address, ',', ';'), ''')')
  ELSE concat('CREATE TABLE t', CAST(c_custkey AS STRING), ' (id INT)') END AS statement
FROM ({PEOPLE}) p"""


@check("o3_sql_dump_scan", ctes(s=_STATEMENTS) + """
SELECT statement, CASE WHEN upper(statement) LIKE 'INSERT%' THEN 'INSERT' WHEN upper(statement) LIKE 'UPDATE%' THEN 'UPDATE' END AS kind FROM s""")
def o3(spark, sf_dir):
    path = scratch_dir(spark, "sql")
    writers.write_statements(derive(spark, sf_dir, _STATEMENTS), "statement", path)
    return sqldump.read_dump(spark, path).select(
        "statement", sqldump.kind(F.col("statement")).alias("kind"))


_TORN = f"""
SELECT c_custkey, concat('INSERT INTO t VALUES (', CAST(c_custkey AS STRING), ', ''', full_name, ';', chr(10), mobile, ''', "it''s;', chr(10), '", ''x'')') AS statement
FROM ({PEOPLE}) p"""


@check("o3_torn_dump", ctes(s=_TORN) + "SELECT statement FROM s")
def o3_torn(spark, sf_dir):
    """Every literal holds the separator at which dumps are cut; comments hold quotes."""
    path = scratch_dir(spark, "torn")
    content = F.encode(F.concat(F.lit("-- don't mind\n"), "statement", F.lit(";\n")), "UTF-8")
    sink.write_files(derive(spark, sf_dir, _TORN).select(
        F.lit("d.sql").alias("name"), F.col("c_custkey").alias("position"), content.alias("content")), path)
    read = sqldump.read_dump(spark, path)
    return read.select(sqldump.without_comments(F.col("statement")).alias("statement")).where("statement != ''")


@check("o19_sanitised_sql_dump", ctes(s=_STATEMENTS) + "SELECT replace(statement, 'Rao', 'PERSON_1') AS statement FROM s")
def o19(spark, sf_dir):
    path = scratch_dir(spark, "sql")
    masked = derive(spark, sf_dir, _STATEMENTS).select(
        F.replace("statement", F.lit("Rao"), F.lit("PERSON_1")).alias("statement"))
    writers.write_statements(masked, "statement", path)
    return sqldump.read_dump(spark, path, whole_files=True).select("statement")


# Tuples: parentheses of depth one, with up to two levels inside.
_TUPLES = r"""
SELECT stmt_id, unnest(t) AS t, unnest(range(len(t))) AS row_no FROM (SELECT stmt_id,
  regexp_extract_all(substr(statement, strpos(upper(statement), 'VALUES') + 6), '\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)', 1) AS t
  FROM s WHERE upper(statement) LIKE 'INSERT%')"""
_UNQUOTED = r"""regexp_replace(trim(v), '^[''"]+|[''"]+$', '', 'g')"""
_INSERTED = f"""
SELECT stmt_id, row_no, pos, {_UNQUOTED} AS value FROM (
  SELECT stmt_id, row_no, unnest(string_split(t, ',')) AS v, unnest(range(len(string_split(t, ',')))) AS pos FROM ({_TUPLES}))
WHERE {_UNQUOTED} <> ''"""
_SET = """
SELECT stmt_id, unnest(string_split(c, ',')) AS a, unnest(range(len(string_split(c, ',')))) AS pos FROM (
  SELECT stmt_id, substr(statement, strpos(upper(statement), 'SET') + 3, CASE WHEN strpos(upper(statement), 'WHERE') > 0
    THEN strpos(upper(statement), 'WHERE') ELSE length(statement) + 1 END - strpos(upper(statement), 'SET') - 3) AS c
  FROM s WHERE upper(statement) LIKE 'UPDATE%')"""
_UPDATED = f"""
SELECT stmt_id, pos, {_UNQUOTED} AS value FROM (SELECT stmt_id, pos, substr(a, strpos(a, '=') + 1) AS v FROM ({_SET}) WHERE contains(a, '='))
WHERE {_UNQUOTED} <> ''"""


def _big(df):
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("row_no", "pos") if c in df.columns})


@check("o4_insert_literals", ctes(s=_STATEMENTS) + _INSERTED)
def o4(spark, sf_dir):
    return _big(sqldump.insert_literals(derive(spark, sf_dir, _STATEMENTS), ["stmt_id"]))


@check("o4_insert_cells_with_labels", ctes(p=PEOPLE) + """
SELECT c_custkey AS stmt_id, 'full_name' AS label, full_name AS value FROM p
UNION ALL SELECT c_custkey, 'address', address FROM p UNION ALL SELECT c_custkey, 'note', 'it''s (ok)' FROM p""")
def o4_cells(spark, sf_dir):
    statements = derive(spark, sf_dir, PEOPLE).select(
        F.col("c_custkey").alias("stmt_id"),
        F.concat(F.lit("INSERT INTO people (full_name, `address`, note) VALUES ('"), "full_name",
                 F.lit("', '"), "address", F.lit("', 'it''s (ok)')")).alias("statement"))
    return sqldump.insert_cells(statements, ["stmt_id"]).select("stmt_id", "label", "value")


@check("o5_update_literals", ctes(s=_STATEMENTS) + _UPDATED)
def o5(spark, sf_dir):
    return _big(sqldump.update_literals(derive(spark, sf_dir, _STATEMENTS), ["stmt_id"]))


@check("o12_literals_joined", ctes(s=_STATEMENTS, i=_INSERTED, u=_UPDATED) + """
SELECT stmt_id, string_agg(value, chr(10) ORDER BY value) AS text FROM (
  SELECT stmt_id, value FROM i UNION ALL SELECT stmt_id, value FROM u) GROUP BY stmt_id""")
def o12(spark, sf_dir):
    values = sqldump.literals(derive(spark, sf_dir, _STATEMENTS), ["stmt_id"])
    return tables.page_text(values, "stmt_id", "value", "value")


# -- documents ----------------------------------------------------------------------------

@check("o7_page_text", "SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def o7(spark, sf_dir):
    pages = derive(spark, sf_dir, "SELECT conv_id AS doc_id, turn, text FROM conversations")
    return tables.page_text(pages, "doc_id", "turn")


def _docx_files(spark, sf_dir, bad=False):
    """One small DOCX file per customer: two paragraphs, a blank one, and a table row."""
    schema = "file_id string, content binary"

    def build(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

        def p(*runs):
            return "<w:p>" + "".join(f"<w:r><w:t>{escape(r)}</w:t></w:r>" for r in runs) + "</w:p>"

        for batch in batches:
            out = []
            for r in batch.itertuples():
                row = "".join(f"<w:tc>{p(c)}</w:tc>" for c in (r.pan, r.mobile))
                # the mobile number is split over two runs
                body = (p("Name: ", r.full_name) + p(" ") + p("Call ", r.mobile[:4], r.mobile[4:])
                        + f"<w:tbl><w:tr>{row}</w:tr></w:tbl>")
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
                content = b"damaged" if bad and r.c_custkey % 5 == 0 else data.getvalue()
                out.append((f"f{r.c_custkey}.docx", content))
            yield pd.DataFrame(out, columns=["file_id", "content"])

    people = spread(derive(spark, sf_dir, PEOPLE).select("c_custkey", "full_name", "mobile", "pan"))
    return people.mapInPandas(build, schema)


_DOCX_SQL = """
SELECT concat('f', CAST(c_custkey AS STRING), '.docx') AS file_id, 0 AS unit_no, concat('Name: ', full_name) AS text FROM p
UNION ALL SELECT concat('f', CAST(c_custkey AS STRING), '.docx'), 1, concat('Call ', mobile) FROM p
UNION ALL SELECT concat('f', CAST(c_custkey AS STRING), '.docx'), 2, concat(pan, ' | ', mobile) FROM p"""


@check("o6_docx_paragraphs", ctes(p=PEOPLE) + _DOCX_SQL)
def o6(spark, sf_dir):
    return docx.docx_units(_docx_files(spark, sf_dir)).drop("error")


@check("o6_docx_damaged_files", ctes(p=PEOPLE) + """
SELECT concat('f', CAST(c_custkey AS STRING), '.docx') AS file_id, 'BadZipFile' AS error FROM p WHERE c_custkey % 5 = 0""")
def o6_bad(spark, sf_dir):
    units = docx.docx_units(_docx_files(spark, sf_dir, bad=True))
    return units.where("error IS NOT NULL").select("file_id", F.substring_index("error", ":", 1).alias("error"))


@check("o20_sanitised_paragraphs", ctes(p=PEOPLE, d=_DOCX_SQL) + """
SELECT file_id, unit_no, replace(text, 'Rao', 'PERSON_1') AS text FROM d""")
def o20(spark, sf_dir):
    path = scratch_dir(spark, "paragraphs")
    units = docx.docx_units(_docx_files(spark, sf_dir)).drop("error")
    writers.write_units(units.withColumn("text", F.replace("text", F.lit("Rao"), F.lit("PERSON_1"))), path)
    return spark.read.parquet(path)


@check("o21_sanitised_pages", """
SELECT conv_id, turn, role, replace(text, 'the', 'TOKEN') AS text FROM conversations""")
def o21(spark, sf_dir):
    path = scratch_dir(spark, "pages")
    pages = derive(spark, sf_dir, "SELECT conv_id, turn, role, text FROM conversations")
    writers.write_units(pages.withColumn("text", F.replace("text", F.lit("the"), F.lit("TOKEN"))), path)
    return spark.read.parquet(path)


# -- catalog --------------------------------------------------------------------------------

_NAMES = """
SELECT c_custkey, concat(CASE c_custkey % 3 WHEN 0 THEN '/data/in.v2/' WHEN 1 THEN '' ELSE 'a/' END, split_part(
  'report.CSV,archive.tar.GZ,.hidden,noext,x.Json,dump.sql,paper.PDF,letter.docx,old.doc,trailing.,sheet.xlsx,.env.csv', ',',
  CAST(c_custkey % 12 + 1 AS INT))) AS name
FROM customer"""
_TYPE_SQL = r"lower(regexp_extract(regexp_replace(regexp_extract(name, '[^/]*$'), '^\.+', ''), '\.([^.]*)$', 1))"
_TYPED = {"n": _NAMES, "t": f"SELECT *, {_TYPE_SQL} AS file_type FROM n"}
_ALLOWED = "file_type IN ('csv', 'json', 'sql', 'pdf', 'docx', 'doc')"


@check("o8_file_type", ctes(**_TYPED) + "SELECT * FROM t")
def o8(spark, sf_dir):
    return derive(spark, sf_dir, _NAMES).withColumn("file_type", catalog.file_type(F.col("name")))


@check("o9_allowed_types", ctes(**_TYPED) + f"""
SELECT c_custkey, name, file_type, CASE WHEN NOT ({_ALLOWED}) THEN concat('Unsupported file type: ', file_type) END AS reason FROM t""")
def o9(spark, sf_dir):
    good, rejected = catalog.split_allowed(derive(spark, sf_dir, _NAMES))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


# A folder of mixed files as (name, content).
_MIXED = f"""
SELECT c_custkey, concat('f', CAST(c_custkey AS STRING), '.', split_part('csv,json,sql,doc,xlsx', ',', CAST(c_custkey % 5 + 1 AS INT))) AS name,
  CASE c_custkey % 5
  WHEN 0 THEN concat('full_name,address', chr(10), full_name, ',"', address, '"', chr(10), '"A ""B"" C",', chr(10))
  WHEN 1 THEN CASE WHEN c_custkey % 10 = 1 THEN concat('{{"person": {{"full_name": "', full_name, '", "pan": "', pan, '"}}}}') ELSE '{{broken' END
  WHEN 2 THEN concat('INSERT INTO t VALUES (''', mobile, ''', ''', pan, ''');', chr(10), 'UPDATE t SET a = ''', email, ''';')
  ELSE 'bytes' END AS body
FROM ({PEOPLE}) p"""


def _mixed(spark, sf_dir):
    return derive(spark, sf_dir, _MIXED).select("name", F.encode("body", "UTF-8").alias("content"))


@check("o13_units_by_type", ctes(p=PEOPLE, m="SELECT c_custkey % 5 AS k, concat('f', CAST(c_custkey AS STRING), '.', split_part('csv,json,sql,doc,xlsx', ',', CAST(c_custkey % 5 + 1 AS INT))) AS file_id, * FROM p") + """
SELECT file_id, 'csv' AS file_type, CAST(NULL AS STRING) AS label, concat('full_name: ', full_name, ' | address: ', address) AS text FROM m WHERE k = 0
UNION ALL SELECT file_id, 'csv', NULL, 'full_name: A "B" C | address: ' FROM m WHERE k = 0
UNION ALL SELECT file_id, 'json', 'full_name', full_name FROM m WHERE c_custkey % 10 = 1
UNION ALL SELECT file_id, 'json', 'pan', pan FROM m WHERE c_custkey % 10 = 1
UNION ALL SELECT file_id, 'sql', NULL, mobile FROM m WHERE k = 2
UNION ALL SELECT file_id, 'sql', NULL, pan FROM m WHERE k = 2
UNION ALL SELECT file_id, 'sql', NULL, email FROM m WHERE k = 2""")
def o13(spark, sf_dir):
    return catalog.mixed_units(_mixed(spark, sf_dir))[0]


@check("o98_rejected_files", ctes(p=_MIXED) + """
SELECT name AS file_id, split_part(name, '.', 2) AS file_type, concat('Unsupported file type: ', split_part(name, '.', 2)) AS reason
FROM p WHERE c_custkey % 5 >= 3
UNION ALL SELECT name, 'json', 'not valid JSON' FROM p WHERE c_custkey % 10 = 6""")
def o98(spark, sf_dir):
    return catalog.mixed_units(_mixed(spark, sf_dir))[1]


_PATHS = "SELECT concat('/in/', name) AS path, body FROM m"


@check("o14_catalog_rows", ctes(m=_MIXED, f=_PATHS) + f"""
SELECT substr(path, 5) AS original_filename, concat(substr(sha256(path), 1, 32), '.', split_part(path, '.', 2)) AS stored_filename,
  split_part(path, '.', 2) AS file_type, path AS original_path, sha256(body) AS file_hash, 'uploaded' AS status, 7 AS uploaded_by
FROM f WHERE split_part(path, '.', 2) IN ('csv', 'json', 'sql', 'doc')""")
def o14(spark, sf_dir):
    files = _mixed(spark, sf_dir).select(F.concat(F.lit("/in/"), "name").alias("path"), "content")
    return catalog.catalog_rows(files, 7).drop("id", "created_at", "sanitized_path")


@check("o14_catalog_of_a_folder", ctes(p=_FLAT) + "SELECT 'csv' AS file_type, true AS hashed, count(*) > 0 AS found FROM p")
def o14_folder(spark, sf_dir):
    path = scratch_dir(spark, "folder")
    writers.write_csv(derive(spark, sf_dir, _FLAT), path)
    rows = catalog.catalog_rows(catalog.read_files(spark, path), 1)
    return rows.groupBy("file_type").agg(
        F.bool_and(F.length("file_hash") == 64).alias("hashed"), (F.count("*") > 0).alias("found"))


@check("o15_fingerprint", "SELECT doc_id, sha256(text) AS hash FROM documents")
def o15(spark, sf_dir):
    docs = derive(spark, sf_dir, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", catalog.fingerprint(F.encode("text", "UTF-8")).alias("hash"))


@check("o15_group_fingerprint", ctes(h="SELECT source, sha256(concat_ws(chr(31), CAST(doc_id AS STRING), text)) AS h FROM documents") + """
SELECT source, count(*) AS n_rows, sha256(concat_ws('/', CAST(count(*) AS STRING),
  CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS STRING), CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS STRING),
  CAST(sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS STRING), CAST(sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS STRING))) AS fingerprint
FROM h GROUP BY source""")
def o15_group(spark, sf_dir):
    docs = derive(spark, sf_dir, "SELECT doc_id, source, text FROM documents")
    return catalog.group_fingerprint(docs, "source", ["doc_id", "text"])


@check("o16_stored_name", ctes(**_TYPED) + """
SELECT name, concat(substr(sha256(name), 1, 32), CASE WHEN file_type = '' THEN '' ELSE '.' END, file_type) AS stored FROM t""")
def o16(spark, sf_dir):
    names = derive(spark, sf_dir, _NAMES)
    stored = catalog.stored_name(F.col("name"), catalog.file_type(F.col("name")))
    return names.select("name", stored.alias("stored"))


@check("o23_output_name", ctes(n=_NAMES) + "SELECT name, 'sanitized_' || name AS output FROM n")
def o23(spark, sf_dir):
    return derive(spark, sf_dir, _NAMES).select("name", catalog.sanitised_name(F.col("name")).alias("output"))


@check("o24_append_runs", ctes(p=PEOPLE) + """
SELECT c_custkey, mobile, 'b' AS run_id FROM p WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, mobile, 'a' FROM p""")
def o24(spark, sf_dir):
    """Run a, run b, and run b again: the repeat replaces its own rows only."""
    path = scratch_dir(spark, "runs")
    people = derive(spark, sf_dir, PEOPLE).select("c_custkey", "mobile")
    half = people.where("c_custkey % 2 = 0")
    writers.append_run(people, path, "a")
    writers.append_run(half, path, "b")
    writers.append_run(half, path, "b")
    table = spark.read.parquet(path)
    return by_id(table, "a", "run_id").unionByName(by_id(table, "b", "run_id"))
