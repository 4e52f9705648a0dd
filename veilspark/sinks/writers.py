"""Sanitised output and control tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BUCKETS = 256


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header that `read_csv` reads back unchanged."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON records with the same nesting; nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_statements(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Statements as a dump, one per line, each ended by a semicolon."""
    df.select(F.concat(F.col(column), F.lit(";")).alias("value")).write.mode(mode).text(path)


def write_units(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Masked paragraphs or pages as a table."""
    df.write.mode(mode).parquet(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of one run in their own partition of a control table. Writing a run again
    replaces that run's rows only, so a repeated batch leaves no duplicates."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def file_bucket(file: str = "file_id"):
    """Bucket number of a file: the partition column of a large vault, so that a look-up by
    file reads one folder."""
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS))


def append_vault(df: DataFrame, path: str, run_id: str, file: str = "file_id") -> None:
    """Vault rows of one run, partitioned by run and file bucket.

    The rebalance hint gathers each bucket in few tasks and splits the bucket of a huge file
    over several, so there are neither many small files nor one endless task."""
    df.withColumn("run_id", F.lit(run_id)).withColumn("file_bucket", file_bucket(file)).hint(
        "rebalance", "file_bucket"
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id", "file_bucket"
    ).parquet(path)


def other_runs(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """What other runs have written to a control table; None before the first one."""
    try:
        rows = control_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.where(F.col("run_id") != run_id).drop("run_id")


def control_table(spark: SparkSession, path: str) -> DataFrame:
    """A control table with run ids as text: `1`, `01` and `2026-01-05` are what they were, and
    not a number or a date of some other spelling."""
    found = spark.read.parquet(path).schema
    text = StructField("run_id", StringType())
    return spark.read.schema(StructType([text if f.name == "run_id" else f for f in found])).parquet(path)


def one_run(path: str, run_id: str, like: DataFrame) -> DataFrame:
    """The rows of a run as they were written; `like` has their columns, so that a run without
    rows can be read too."""
    schema = StructType([*like.schema, StructField("run_id", StringType())])
    return like.sparkSession.read.schema(schema).parquet(path).where(F.col("run_id") == run_id).drop("run_id")
