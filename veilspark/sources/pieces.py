"""Files as pieces that can be masked and put together again in the format they came in.

A piece is a stretch of a file that holds values, with the stretch before it that holds none:
`lead` + masked piece, in order of `position`, is the file. What is not masked stays as it is, to
the byte. `text` is the piece as its format means it (without quotes and escapes): there values are
looked for. `units` are the texts in which they are detected, with their labels. CSV, JSON and SQL
files are first cut into stretches (see `chunks`), and these by many tasks; the leaves of a JSON file are
found in slices of its array, those of a file that is no array in one task.

| type | pieces | units |
|---|---|---|
| csv | records | rendered rows, without the header |
| json | strings (keys apart) and numbers | leaves, labelled by the nearest key |
| sql | stretches between separators, quoted literals whole | literals, labelled by their column |
| docx | paragraphs and table rows | the same |
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.mask import prepared, replace_all, replace_prepared
from ..operators.skew import LARGE_ROWS, written
from . import chunks, sqldump
from .catalog import file_type, read_files
from .chunks import cut_files, marked_slices, parsed_slices
from .csvtext import RECORD, csv_cell, csv_cells, csv_raw_cells, csv_row
from .docx import cut_packages, docx_units, package_units
from .nested import LITERAL, literal_text, text_leaves, text_literal
from .opened import not_utf8

TEXT_TYPES = ["csv", "json", "sql"]

# SQL up to the next separator outside of quotes.
_SQL = r"""(?s)(?:[^'"(),;]++|'[^']*+'|"[^"]*+"|['"])++"""


# JSON texts from here on are judged by the parser that cuts them only: one VARIANT is of 128 MB at most.
LARGE_JSON = 32_000_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_folder(spark, path: str) -> DataFrame:
    """(file_id, folder, file_type, length) of all files below a folder; file_id is the path below it.
    Tasks open the files themselves (see `opened`), so they may be of any size."""
    # as Spark spells it: file:/in, whether it was called /in, file:/in or file:///in/
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named)
    place = root.toUri().getPath() if root.toUri().getScheme() == "file" else path
    below = F.regexp_extract(F.regexp_replace("path", "^file:/+", "file:/"), rf"\A\Q{root.toString().rstrip('/')}\E/(.*)\z", 1).alias("file_id")
    # rows are stretches of files: what a task passes to Python at once, and holds twice, is bounded
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, "8m")
    read = read_files(spark, path)
    files = read.select(below, F.lit(place).alias("folder"), "length")
    # Spark lists files without a byte, but gives no row of them
    listed = spark.createDataFrame([(unquote(f),) for f in read.inputFiles()], "path string").select(below)
    empty = listed.join(files.select("file_id"), "file_id", "left_anti")
    files = files.unionByName(empty.select("file_id", F.lit(place).alias("folder"), F.lit(0).cast("bigint").alias("length")))
    return files.withColumn("file_type", file_type(F.col("file_id")))


@dataclass
class Parts:
    """What files are cut into, each table written once: stretches of text files, slices of JSON
    files, fragments of DOCX packages and their units."""

    cut: DataFrame
    slices: DataFrame
    packages: DataFrame
    paragraphs: DataFrame

    def of(self, files: DataFrame) -> Parts:
        kept = files.select("file_id")
        return Parts(*(t.join(kept, "file_id", "left_semi") for t in (self.cut, self.slices, self.packages, self.paragraphs)))


def parts(files: DataFrame) -> Parts:
    packages = cut_packages(files.where("file_type = 'docx'"))
    return Parts(cut_files(files), marked_slices(files), packages, written(package_units(packages), "docx-units"))


def rejects(files: DataFrame, read: Parts | None = None) -> DataFrame:
    """(file_id, file_type, reason) of the files that cannot be masked; they are never passed on."""
    kind = F.col("file_type")
    is_text = kind.isin(TEXT_TYPES)
    unsupported = files.where(~is_text & (kind != "docx")).select(
        "file_id", "file_type", F.concat(F.lit("Unsupported file type: "), kind).alias("reason"))
    encoded = not_utf8(files.where(is_text)).withColumn("reason", F.lit("not valid UTF-8"))
    slices = read.slices if read else marked_slices(files)
    bad = F.col("_text").isNull() | (F.length("_text") < LARGE_JSON) & F.try_parse_json("_text").isNull()
    parsed = slices.where(bad).select("file_id").distinct().select(
        "file_id", F.lit("json").alias("file_type"), F.lit("not valid JSON").alias("reason"))
    units = read.paragraphs if read else docx_units(files.where(kind == "docx"))
    damaged = units.where("error IS NOT NULL").select(
        "file_id", F.lit("docx").alias("file_type"), F.col("error").alias("reason"))
    return unsupported.unionByName(encoded).unionByName(parsed).unionByName(damaged)


# -- units -------------------------------------------------------------------------

def units(files: DataFrame, read: Parts | None = None) -> DataFrame:
    """(file_id, unit_id, position, label, text) as `batch.run` takes them."""
    none = F.lit(None).cast("string")
    cut = read.cut if read else cut_files(files.where("file_type != 'json'"))
    rows = _records(cut).where("position > 0 AND raw IS NOT NULL").select(
        "file_id", F.col("position").cast("string").alias("unit_id"), "position", none.alias("label"), "text")
    leaves = _leaves(read.slices if read else marked_slices(files)).select("file_id", F.col("position").cast("string").alias("unit_id"), "position",
                                   F.col("leaf.label").alias("label"), F.col("leaf.text").alias("text"))
    dumps = cut.where("file_type = 'sql'").select(
        "file_id", "chunk", F.posexplode(F.regexp_extract_all("_text", F.lit(sqldump.STATEMENT), F.lit(0)))
        .alias("position", "statement"))
    dumps = dumps.withColumns({
        "position": chunks.place(F.col("chunk"), F.col("position")),
        "statement": sqldump.strip(sqldump.without_comments(F.col("statement")))})
    keys = ["file_id", "position"]
    cells = sqldump.insert_cells(dumps, keys).select(
        *keys, F.concat_ws("/", "position", "row_no", "pos").alias("unit_id"), "label", "value")
    sets = sqldump.update_cells(dumps, keys).select(
        *keys, F.concat_ws("/", "position", "pos").alias("unit_id"), "label", "value")
    literals = cells.unionByName(sets).withColumnRenamed("value", "text")
    found = read.paragraphs if read else docx_units(files.where("file_type = 'docx'"))
    paragraphs = found.where("error IS NULL").select("file_id", F.col("unit_no").cast("string").alias("unit_id"),
                             F.col("unit_no").alias("position"), none.alias("label"), "text")
    return rows.unionByName(leaves).unionByName(literals).unionByName(paragraphs)


def _leaves(marked: DataFrame) -> DataFrame:
    """(file_id, position, leaf) of sliced JSON files, numbered from 0 within their file. A slice of a file
    holds some thousand leaves, so no row carries those of a large file."""
    slices = written(parsed_slices(marked).select("file_id", "chunk", text_leaves("_text").alias("leaves")), "json-leaves", LARGE_ROWS)
    earlier = W.partitionBy("file_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = slices.select("file_id", "chunk", F.size("leaves").alias("_n")).select(
        "file_id", "chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = slices.join(before, ["file_id", "chunk"]).select("file_id", "_before", F.posexplode("leaves").alias("k", "leaf"))
    return rows.select("file_id", (F.col("_before") + F.col("k")).alias("position"), "leaf")


def _records(cut: DataFrame) -> DataFrame:
    """Records of CSV files with their rendered text; the header is record 0."""
    # named before the records are dealt out, else each of them would carry all others
    csv = cut.where("file_type = 'csv'").withColumn("names", csv_cells(F.col("head")))
    rows = _cut(csv, RECORD, "names")
    return rows.withColumn("text", F.when(F.col("position") > 0, csv_row(F.col("names"), F.col("raw"))))


# -- pieces ------------------------------------------------------------------------

def _cut(texts: DataFrame, pattern: str, *more: str) -> DataFrame:
    """(file_id, position, lead, raw, next, more): the matches, the gaps before them and after
    them; a last row of each stretch, without `raw`, has what follows the last match as its lead."""
    parts = texts.select(
        "file_id", "chunk", *more, F.split("_text", pattern, -1).alias("lead"),
        F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("raw"))
    parts = parts.withColumn("next", F.slice("lead", 2, F.size("lead")))
    # zipped, so that a row carries its own piece and not the whole stretch
    zipped = F.arrays_zip("lead", "raw", "next")
    rows = parts.select("file_id", "chunk", *more, F.posexplode(zipped).alias("position", "p"))
    return rows.select("file_id", chunks.place(F.col("chunk"), F.col("position")).alias("position"), "p.*", *more)


def pieces(files: DataFrame, read: Parts | None = None) -> DataFrame:
    """(file_id, file_type, position, lead, raw, text) of CSV, JSON and SQL files. `text` is null
    where nothing is masked: headers, keys, and what follows the last piece."""
    cut = read.cut if read else cut_files(files)
    records = _records(cut).select(
        "file_id", F.lit("csv").alias("file_type"), "position", "lead", "raw", "text")
    is_key = F.col("raw").startswith('"') & F.col("next").rlike(r"^\s*:")
    tokens = _cut(cut.where("file_type = 'json'"), LITERAL).select(
        "file_id", F.lit("json").alias("file_type"), "position", "lead", "raw",
        F.when(~is_key, literal_text(F.col("raw"))).alias("text"))
    dumps = _cut(cut.where("file_type = 'sql'"), _SQL).select(
        "file_id", F.lit("sql").alias("file_type"), "position", "lead", "raw", F.col("raw").alias("text"))
    return records.unionByName(tokens).unionByName(dumps)


# -- masked ------------------------------------------------------------------------

def _masked_cells(record: Column, mapping: Column) -> Column:
    """A CSV record with its cells masked; cells that stay are kept as they are written."""
    def cell(c, p):
        plain = csv_cell(c)
        masked = replace_prepared(plain, p)
        quoted = F.concat(F.lit('"'), F.replace(masked, F.lit('"'), F.lit('""')), F.lit('"'))
        written = F.when(masked.rlike('[",\r\n]'), quoted).otherwise(masked)
        return F.when(masked == plain, c).otherwise(written)

    cells = F.transform(F.array(prepared(mapping)), lambda p: F.transform(csv_raw_cells(record), lambda c: cell(c, p)))
    return F.array_join(F.get(cells, F.lit(0)), ",")


def masked(piece: Column, kind: Column, text: Column, mapping: Column) -> Column:
    """The piece with the values of its mapping (value, token) replaced, in its own format. JSON
    numbers that hold a value become strings. SQL is replaced as it is written."""
    plain = replace_all(text, mapping)
    changed = (
        F.when(kind == "csv", _masked_cells(piece, mapping))
        .when(kind == "json", F.when(plain == text, piece).otherwise(text_literal(plain)))
        .otherwise(replace_all(piece, mapping)))
    return F.when(mapping.isNull() | text.isNull(), piece).otherwise(changed)
