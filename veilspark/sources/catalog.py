"""File types, fingerprints, catalog rows, and reading a folder of mixed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .blocks import BLOCK, merkle, read_blocks, roots
from .csvtext import RECORD, csv_cells, csv_row
from .docx import docx_units
from .nested import text_leaves
from .sqldump import literals, split_statements

MAX_BYTES = 2_000_000_000  # one value cannot be larger


def file_type(name: Column) -> Column:
    """Lower-case last extension without the dot, "" if there is none. Leading dots of the
    base name do not start an extension."""
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"\.([^.]*)\z", 1))


def is_allowed(kind: Column) -> Column:
    return kind.isin(C.ALLOWED_TYPES)


def split_allowed(files: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Files of a supported type, and the rejected rest with a reason."""
    typed = files.withColumn("file_type", file_type(F.col(name)))
    ok = is_allowed(F.col("file_type"))
    reason = F.concat(F.lit("Unsupported file type: "), F.col("file_type"))
    return typed.where(ok), typed.where(~ok).withColumn("reason", reason)


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def group_fingerprint(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One SHA-256 per group of rows, without gathering a group.

    Rows are hashed one by one (name the position or key among the columns); the row hashes
    of a group are added up in four lanes of 60 bits, which is done map-side before the
    shuffle, and the sums are hashed together with the row count. Repeated rows add up, so
    they do not cancel out.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    lanes = {
        f"_x{i}": F.sum(F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    }
    hashed = df.select(group, F.sha2(F.concat_ws("\x1f", *cells), 256).alias("_h"))
    per_group = hashed.groupBy(group).agg(
        F.count("*").alias("n_rows"), *[x.alias(name) for name, x in lanes.items()]
    )
    text = F.concat_ws("/", "n_rows", *lanes)
    return per_group.select(group, "n_rows", F.sha2(text, 256).alias("fingerprint"))


def stored_name(path: Column, kind: Column) -> Column:
    """Collision-free name that a retry computes again: 32 hex digits of the path's hash."""
    name = F.substring(F.sha2(path, 256), 1, 32)
    return F.when(kind == "", name).otherwise(F.concat_ws(".", name, kind))


def sanitised_name(name: Column) -> Column:
    return F.concat(F.lit("sanitized_"), name)


def catalog_rows(files: DataFrame, uploaded_by: int) -> DataFrame:
    """Catalog entries from `binaryFile` columns (path, modificationTime, length, content)."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    kind = file_type(name)
    return files.select(
        F.xxhash64("path").alias("id"),
        name.alias("original_filename"),
        stored_name(F.col("path"), kind).alias("stored_filename"),
        kind.alias("file_type"),
        F.col("path").alias("original_path"),
        F.lit(None).cast("string").alias("sanitized_path"),
        fingerprint(F.col("content")).alias("file_hash"),
        F.lit("uploaded").alias("status"),
        F.lit(uploaded_by).alias("uploaded_by"),
        F.current_timestamp().alias("created_at"),
    ).where(is_allowed(F.col("file_type")))


def catalog_of_any_size(spark: SparkSession, path: str, uploaded_by: int, block: int = BLOCK) -> DataFrame:
    """`catalog_rows` of a folder whose files may be larger than one value: `file_hash` is the root of
    the file's Merkle tree, and no task holds a file. `id` and names follow from the path."""
    tree = roots(merkle(read_blocks(spark, path, block)))
    kind = file_type(F.col("file_id"))
    full = F.concat(F.lit(path.rstrip("/") + "/"), "file_id")
    return tree.select(
        F.xxhash64(full).alias("id"), F.regexp_extract("file_id", r"([^/]*)\z", 1).alias("original_filename"),
        stored_name(full, kind).alias("stored_filename"), kind.alias("file_type"), full.alias("original_path"),
        F.lit(None).cast("string").alias("sanitized_path"), F.col("fingerprint").alias("file_hash"),
        F.lit("uploaded").alias("status"), F.lit(uploaded_by).alias("uploaded_by"),
        F.current_timestamp().alias("created_at"), "n_bytes",
    ).where(is_allowed(F.col("file_type")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their bytes, all of them: a file that is larger than one value can be
    (see `oversized_files`) ends the job and is not left out. `pieces.read_folder` and
    `catalog_of_any_size` hold no file."""
    return _binary(spark, path)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def oversized_files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """The files that `read_files` cannot read, without reading them, with a reason."""
    reason = F.concat(F.lit("larger than one value: "), F.col("length"), F.lit(" bytes"))
    big = _binary(spark, path).select("path", "modificationTime", "length").where(F.col("length") > limit)
    return big.withColumn("reason", reason)


def catalog_rejects(files: DataFrame) -> DataFrame:
    """The files for which `catalog_rows` makes no entry, with a reason: path, file_type, reason."""
    named = files.select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"))
    return split_allowed(named)[1].select("path", "file_type", "reason")


def _csv_units(files: DataFrame) -> DataFrame:
    """Rendered rows of CSV files, each with its own header."""
    records = F.regexp_extract_all("_text", F.lit(RECORD), F.lit(0))
    rows = files.select("file_id", "file_type", records.alias("_records")).select(
        "file_id", "file_type", csv_cells(F.get("_records", F.lit(0))).alias("_names"),
        F.explode(F.slice("_records", 2, F.greatest(F.size("_records") - 1, F.lit(0))))
        .alias("_record"),
    )
    return rows.select(
        "file_id", "file_type", F.lit(None).cast("string").alias("label"),
        csv_row(F.col("_names"), F.col("_record")).alias("text"),
    )


def _json_units(files: DataFrame) -> DataFrame:
    """Leaves of JSON files of any shapes, with the nearest key as label."""
    parsed = files.where(F.try_parse_json("_text").isNotNull())
    leaf = F.explode(text_leaves("_text")).alias("_leaf")
    return parsed.select("file_id", "file_type", leaf).select(
        "file_id", "file_type", F.col("_leaf.label").alias("label"), F.col("_leaf.text").alias("text")
    )


def mixed_units(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text units of a table of files (name, content) by type, and the rejected files.

    Units: (file_id, file_type, label, text). CSV gives rendered rows, JSON its leaves with
    the key as label, SQL its literals, DOCX its paragraphs. `.doc`, `.pdf`, unknown types
    and damaged files are rejected with a reason. Meant for many files of moderate size;
    single large files go through the reader of their type, which splits them.
    """
    typed = files.withColumn("file_type", file_type(F.col("name"))).withColumnRenamed(
        "name", "file_id"
    )
    as_text = F.col("content").cast("string")
    is_text = F.col("file_type").isin("csv", "json", "sql")

    def of(kind):
        valid = typed.where((F.col("file_type") == kind) & F.is_valid_utf8(as_text))
        return valid.select("file_id", "file_type", as_text.alias("_text"))

    no_label = F.lit(None).cast("string").alias("label")
    statements = split_statements(of("sql").select("file_id", "_text"), "_text")
    values = literals(statements, ["file_id"]).select(
        "file_id", F.lit("sql").alias("file_type"), no_label, F.col("value").alias("text")
    )
    read = docx_units(typed.where(F.col("file_type") == "docx"))
    paragraphs = read.where(F.col("error").isNull()).select(
        "file_id", F.lit("docx").alias("file_type"), no_label, "text"
    )
    units = (
        _csv_units(of("csv")).unionByName(_json_units(of("json")))
        .unionByName(values).unionByName(paragraphs)
    )
    readable = F.col("file_type").isin("csv", "json", "sql", "docx")
    unsupported = typed.where(~readable).select(
        "file_id", "file_type",
        F.concat(F.lit("Unsupported file type: "), F.col("file_type")).alias("reason"),
    )
    bad_json = of("json").where(F.try_parse_json("_text").isNull()).select(
        "file_id", "file_type", F.lit("not valid JSON").alias("reason")
    )
    bad_docx = read.where(F.col("error").isNotNull()).select(
        "file_id", F.lit("docx").alias("file_type"), F.col("error").alias("reason")
    )
    bad_text = typed.where(is_text & ~F.coalesce(F.is_valid_utf8(as_text), F.lit(False))).select(
        "file_id", "file_type", F.lit("not valid UTF-8").alias("reason")
    )
    rejected = unsupported.unionByName(bad_json).unionByName(bad_docx).unionByName(bad_text)
    return units, rejected
