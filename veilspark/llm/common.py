"""Shared by the operators: input columns, written intermediate tables, batches in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import scratch_dir

# What separates words for most operators.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: later steps, and repeated
    tasks after a lost executor, read files instead of computing everything again."""
    path = scratch_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast. Spark takes the size of a table from
    its compressed files, also where rows have been exploded since, and would pass through the driver
    what is many times as large."""
    return df.hint("merge")


def take_columns(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: whatever else the input has,
    also under clashing names, does not matter."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


# Texts can be long: what a Python worker holds at once is bounded in rows and bytes, unless
# the session says otherwise.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def map_arrow(df: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """`mapInArrow` with small batches."""
    conf = df.sparkSession.conf
    for name, value in BATCH.items():
        if conf.get(name, None) is None:
            conf.set(name, value)
    return df.mapInArrow(fn, schema)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str
) -> DataFrame:
    """`map_arrow` with a function of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts one at a time (a null text is empty): a batch is never held twice."""
    for value in column(batch, name):
        yield value.as_py() or ""
