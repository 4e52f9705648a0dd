"""Joins and row numbers that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import scratch_dir

MAX_HOT_KEYS = 10_000
SALTS = 16
DEAL = 1024


# A broadcast row of a hot key takes at most so many bytes: 10,000 of them are 8 MB.
MAX_HOT_BYTES = 800


# Bytes of a row group; sizes are looked at from so many rows on (100 where nothing is said).
LARGE_ROWS = 32
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared scratch folder and go on from there. Cuts the lineage,
    survives lost executors, and lets later steps read only the columns they need. A task that reads
    it holds up to 4096 rows of a row group at once: large rows need `rows`, how many a row group may
    have, as its bytes are those of compressed pages."""
    path = scratch_dir(df.sparkSession, name)
    limit = {"parquet.block.row.count.limit": rows} if rows else {}
    df.write.options(**ROW_GROUPS, **limit).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], cols: list[str], how: str = "inner"
) -> DataFrame:
    """Inner or left join of written `rows` to a `lookup` with one row per key whose hot keys are
    not known: the rows of each key are counted (combined before the shuffle), then `lookup_join`."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    counted = written(lookup.select(*keys, *cols).join(counts, keys), "counted")
    return lookup_join(rows, counted, keys, "_rows", cols, how)


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], count: str, cols: list[str],
    how: str = "inner",
) -> DataFrame:
    """Inner or left join of `rows` to a `lookup` with one row per key and a known row count.

    A key is hot when it covers more than 1/10,000 of all rows; hence there are at most
    10,000 hot keys, and their part of the lookup is broadcast, as far as its rows are small: at
    most 10,000 * `MAX_HOT_BYTES` in all. All other keys are joined by a shuffle; rows that already
    found their hot key are dealt out evenly, and larger rows of the lookup are repeated, so that
    the rows of their hot keys are spread. `rows` is read once; `lookup` should be a written table, as it is read for the
    total and for each part.
    """
    total = lookup.agg(F.sum(count)).scalar()
    held = F.struct(F.lit(True).alias("_there"), *cols)
    marked = lookup.select(
        *keys, held.alias("_row"), F.length(F.to_json(held)).alias("_bytes"), F.col(count).alias("_count"))
    is_hot = F.col("_count") > F.greatest(total / MAX_HOT_KEYS, F.lit(1000))
    is_small = F.col("_bytes") <= MAX_HOT_BYTES
    hot = marked.where(is_hot).select(
        *keys, F.when(is_small, F.col("_row")).alias("_hot"), (~is_small).alias("_large"))
    cold = marked.where(~(is_hot & is_small)).select(
        *keys, F.col("_row").alias("_cold"),
        F.explode(F.when(is_hot, F.sequence(F.lit(-SALTS), F.lit(-1))).otherwise(F.array(F.lit(0)))).alias("_deal"))
    # row number within the task: the same again if the task is repeated
    number = F.monotonically_increasing_id()
    deal = (
        F.when(F.col("_large"), -1 - F.pmod(number, F.lit(SALTS)))
        .when(F.col("_hot").isNotNull(), 1 + F.pmod(number, F.lit(DEAL))).otherwise(F.lit(0))
    )
    tried = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", deal.cast("int"))
    joined = tried.join(cold, [*keys, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return (
        (joined if how == "left" else joined.where(F.col("_found").isNotNull()))
        .select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in cols])
    )


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread: list[str], salts: int = SALTS
) -> DataFrame:
    """Inner join of many rows to a much smaller table whose hot keys are not known: each
    key's rows are spread over `salts` tasks by the `spread` columns, and the small table is
    repeated once per salt."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    repeated = repeated.withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")


def with_row_number(
    df: DataFrame, order: list[str], name: str = "row_no", within: str | None = None
) -> DataFrame:
    """Number all rows in a given order without sending them through one task.

    Rows are range-partitioned and written with the number of their range, so that the
    ranges stay the same however often they are read. Rows are numbered within each range,
    and the sizes of the ranges before it are added. With `within`, numbers restart at 1 for
    each of its values; a value with very many rows simply spans many ranges.
    """
    spark: SparkSession = df.sparkSession
    group = [within] if within else []
    path = scratch_dir(spark, "row-numbers")
    ranged = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    spread = spark.read.parquet(path)
    part = ["_part", *group]
    local = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    # one row per range and value
    sizes = spread.groupBy(*part).agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (
        spread.withColumn(name, local)
        .join(offsets, part)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_part", "_before")
    )
