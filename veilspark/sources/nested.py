"""JSON files of any nesting."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mask import replace_all
from ..operators.skew import written

LEAVES = "array<struct<path:string,label:string,text:string,is_string:boolean>>"


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Records with their inferred nested schema, plus `file_id`.

    One record per line by default, which is splittable; `multi_line` reads files that hold
    one document or one array of records, each file in one task.
    """
    df = spark.read.option("multiLine", multi_line).json(path)
    return df.select(F.col("_metadata.file_name").alias("file_id"), "*")


def read_variant(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Each line, or each file with `whole_files`, as one VARIANT value, without any schema."""
    texts = spark.read.text(path, wholetext=whole_files)
    return texts.select(
        F.col("_metadata.file_name").alias("file_id"), F.parse_json("value").alias("content")
    )


def typed_variant(df: DataFrame, column: str) -> DataFrame:
    """Give a VARIANT column the one schema that fits all its values, found in one pass."""
    ddl = df.agg(F.schema_of_variant_agg(column)).first()[0]
    ddl = ddl.replace("OBJECT<", "STRUCT<")
    return df.withColumn(column, F.variant_get(column, "$", ddl))


def leaves(value: Column, dtype: T.DataType, path: str = "", label: str = "") -> Column:
    """Leaf values as (path, label, text, is_string); the label is the nearest key.

    The expression is built from the schema; nulls yield no leaf.
    """
    if isinstance(dtype, T.StructType):
        parts = [
            leaves(value.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name,
                   f.name)
            for f in dtype.fields
        ]
        return F.concat(*[F.coalesce(p, F.array().cast(LEAVES)) for p in parts])
    if isinstance(dtype, T.ArrayType):
        return F.flatten(F.transform(
            F.coalesce(value, F.array().cast(dtype)),
            lambda x: F.coalesce(leaves(x, dtype.elementType, f"{path}[]", label),
                                 F.array().cast(LEAVES)),
        ))
    if isinstance(dtype, T.MapType):
        return F.flatten(F.transform(
            F.map_entries(F.coalesce(value, F.create_map().cast(dtype))),
            lambda e: F.array(F.struct(
                F.concat(F.lit(f"{path}."), e["key"]).alias("path"), e["key"].alias("label"),
                e["value"].cast("string").alias("text"),
                F.lit(isinstance(dtype.valueType, T.StringType)).alias("is_string"),
            )),
        ))
    one = F.array(F.struct(
        F.lit(path).alias("path"), F.lit(label).alias("label"),
        value.cast("string").alias("text"),
        F.lit(isinstance(dtype, T.StringType)).alias("is_string"),
    ))
    return F.when(value.isNotNull(), one).otherwise(F.array().cast(LEAVES))


def _walk(node, path: str = "", label: str = "") -> list[tuple]:
    """Leaves of a parsed JSON value; an explicit stack, so that depth is no limit."""
    out, stack = [], [(node, path, label)]
    while stack:
        node, path, label = stack.pop()
        if isinstance(node, dict):
            inner = [(v, f"{path}.{k}" if path else k, k) for k, v in node.items()]
            stack.extend(reversed(inner))
        elif isinstance(node, list):
            stack.extend((v, f"{path}[]", label) for v in reversed(node))
        elif node is not None:
            text = str(node).lower() if isinstance(node, bool) else str(node)
            out.append((path, label, text, isinstance(node, str) and not isinstance(node, _Number)))
    return out


class _Number(str):
    """A number as it is written."""


def text_leaves(text: str) -> Column:
    """Leaves of JSON texts as (path, label, text, is_string), each text by its own shape: no
    common schema is needed. Texts that do not parse have no leaves."""

    def leaves_of(value: str | None) -> list[tuple]:
        try:
            return _walk(json.loads(value, parse_int=_Number, parse_float=_Number)) if value else []
        except (ValueError, RecursionError):
            return []

    return F.udf(leaves_of, LEAVES, useArrow=True)(F.col(text))


CONTAINER = r"^(?:OBJECT|ARRAY)<"


def variant_leaves(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, path, label, text, is_string): the leaves of a VARIANT column, each value by its own
    shape; nulls inside give no leaf. `path` has `[]` for any place in an array, `label` is the
    nearest key.

    Level by level: what is not a container is a leaf, the containers are taken apart and go on. Each
    level is written, so that the next one reads only what is left; there are as many as the deepest
    value has, and no schema passes through the driver.
    """
    spark = df.sparkSession
    blank = F.lit("")
    level = df.select(*keys, blank.alias("path"), blank.alias("label"), F.col(column).alias("_v"))
    found, number = None, 0
    while True:
        typed = level.where(F.col("_v").isNotNull()).withColumn("_kind", F.schema_of_variant("_v"))
        level = written(typed.withColumn("_json", F.to_json("_v")).drop("_v"), f"variant-{number}")
        here = level.where(~F.col("_kind").rlike(CONTAINER) & (F.col("_kind") != "VOID"))
        value = F.parse_json("_json")
        leaf = here.select(*keys, "path", "label", F.variant_get(value, "$", "string").alias("text"),
                           (F.col("_kind") == "STRING").alias("is_string"))
        found = leaf if found is None else found.unionByName(leaf)
        inner = level.where(F.col("_kind").rlike(CONTAINER))
        if inner.isEmpty():
            return found
        number += 1
        parts = inner.select(*keys, "path", "label", value.alias("_v")).lateralJoin(
            spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_inner"))
        child = F.when(F.col("path") == "", F.col("_key")).otherwise(F.concat_ws(".", "path", "_key"))
        level = parts.select(
            *keys, F.when(F.col("_key").isNull(), F.concat("path", F.lit("[]"))).otherwise(child).alias("path"),
            F.coalesce("_key", "label").alias("label"), F.col("_inner").alias("_v"))


# JSON strings and numbers; a string is a key where a colon follows.
LITERAL = r'(?s)"(?:[^"\\]++|\\.)*+"|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?'


def literal_text(literal: Column) -> Column:
    """What a JSON string or number literal says."""
    parsed = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(literal.startswith('"'), F.coalesce(parsed, literal)).otherwise(literal)


def text_literal(text: Column) -> Column:
    """The JSON string literal that says a text."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def mask_json(text: Column, mapping: Column) -> Column:
    """A JSON text with the values of the mapping (value, token) replaced in its strings and numbers,
    whatever its shape. Keys, blanks and all other literals stay as they are written; a number that
    holds a value becomes a string."""
    gaps = F.split(text, LITERAL, -1)
    hits = F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))

    def one(hit, i):
        plain = literal_text(hit)
        masked = replace_all(plain, mapping)
        is_key = hit.startswith('"') & F.get(gaps, i + 1).rlike(r"^\s*:")
        return F.concat(F.when(is_key | (masked == plain), hit).otherwise(text_literal(masked)), F.get(gaps, i + 1))

    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(hits, one), ""))


def mask_variant(value: Column, mapping: Column) -> Column:
    """`mask_json` of a VARIANT, as a VARIANT."""
    return F.parse_json(mask_json(F.to_json(value), mapping))


def leaf_rows(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per leaf of a nested column."""
    dtype = df.schema[column].dataType
    rows = df.select(*keys, F.explode_outer(leaves(F.col(column), dtype)).alias("_leaf"))
    return rows.where(F.col("_leaf.path").isNotNull()).select(*keys, "_leaf.*")


def render_json(value: Column) -> Column:
    """Readable JSON text of a record, indented, other scripts kept as they are."""
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})
