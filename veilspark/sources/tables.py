"""CSV files and other flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import torn
from .csvtext import csv_cells

# Cells beyond the header's width.
EXTRA = "extra"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, _path, _block, _row, value): the records of CSV files as they are written, ordered
    by _block and _row within a file. Lines are pieces; cells may hold line breaks. Every file is
    split freely, and one file with breaks in its cells changes nothing for the others."""
    def end_states(line):
        odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2
        return F.array(odd, 1 - odd)

    records = torn.rejoined(torn.read_pieces(spark, path, "\n", end_states), "\n")
    value = F.regexp_replace("value", r"\r\z", "")
    return records.withColumn("value", value)


def read_csv(spark: SparkSession, path: str, extra: str | None = EXTRA) -> DataFrame:
    """All columns as strings, blanks as "", plus `file_id` (the file's name) and, as an array named
    `extra` (None: left out), the cells that a record has beyond the header's width. Cells that it
    lacks are "". Blank lines are no records.

    All files of one call must have the same header, else ValueError.
    """
    records = read_records(spark, path)
    first = (F.col("_block") == 0) & (F.col("_row") == 0)
    headers = records.where(first).select(F.regexp_replace("value", "^\ufeff", "").alias("h")).distinct().take(2)
    if len(headers) != 1:
        raise ValueError(f"{path}: files with different headers" if headers else f"{path}: no file with a header")
    names = spark.range(1).select(csv_cells(F.lit(headers[0].h)).alias("n")).first().n
    rows = records.where(~first & (F.col("value") != "")).select("file_id", csv_cells(F.col("value")).alias("_cells"))
    cells = [F.coalesce(F.get("_cells", F.lit(k)), F.lit("")).alias(name) for k, name in enumerate(names)]
    beyond = F.slice("_cells", len(names) + 1, F.greatest(F.size("_cells") - len(names), F.lit(0)))
    return rows.select("file_id", *cells, *([beyond.alias(extra)] if extra else []))


def render_row(columns: list[str]) -> Column:
    """`name: value | name: value` for one row; nulls read as ""."""
    cells = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
        for c in columns
    ]
    return F.concat_ws(" | ", *cells)


def row_id(columns: list[str]) -> Column:
    """Content-based id of a row: the same whenever and wherever it is computed. Equal rows
    share it, and have the same detections."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.to_json(F.array(*cells)), 256)


def as_cells(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per cell with its column name as label: the column-aware form."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("string").alias("text"))
        for c in columns
    ])
    return df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def page_text(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Pages of one document joined by line breaks, in page order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text")
    )
