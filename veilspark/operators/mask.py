"""Replacing detected values by their tokens."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.spans import blocks, slice_text
from .skew import counted_join, lookup_join, salted_join
from .vault import LETTERS, TOKEN_DIGITS
from .winnow import find_values

MAPPING = "array<struct<value:string,token:string>>"


# -- dictionary form: every occurrence of every value of a (small) mapping -----

def longest_first(mapping: Column) -> Column:
    """Order for replacement: longest value first, then by value."""
    keyed = F.transform(
        mapping,
        lambda m: F.struct((-F.length(m["value"])).alias("n"), m["value"].alias("value"),
                           m["token"].alias("token")),
    )
    return F.sort_array(keyed)


def prepared(mapping: Column) -> Column:
    """A mapping as `replace_prepared` takes it: sorted, and as one pattern. For rows with many
    texts, so that this is done once for each row."""
    entries = longest_first(F.filter(mapping, lambda m: F.length(m["value"]) > 0))
    sorted_once = F.transform(F.array(entries), lambda e: F.struct(
        F.transform(e, lambda m: m["value"]).alias("values"), F.transform(e, lambda m: m["token"]).alias("tokens"),
        F.array_join(F.transform(e, lambda m: quoted(m["value"])), "|").alias("pattern")))
    return F.get(sorted_once, F.lit(0))


def replace_prepared(text: Column, p: Column) -> Column:
    """`replace_all` with a prepared mapping. Texts that hold none of the values stay."""
    gaps = F.split(text, p["pattern"], -1)
    hits = F.regexp_extract_all(text, p["pattern"], F.lit(0))
    # one gap more than hits
    parts = F.transform(F.arrays_zip(gaps.alias("gap"), F.concat(F.array(F.lit("")), hits).alias("hit")), lambda x, i: F.when(
        i == 0, x["gap"]).otherwise(
        F.concat(F.get(p["tokens"], F.array_position(p["values"], x["hit"]).cast("int") - 1), x["gap"])))
    there = F.exists(p["values"], lambda v: F.contains(text, v))
    return F.when(there, F.array_join(parts, "")).otherwise(text)


def replace_all(text: Column, mapping: Column) -> Column:
    """Replace every occurrence of every value in one pass over the text: from left to right,
    the longest value that starts at a place first. Inserted tokens are never searched again,
    so each of them leads back to its value. The mapping belongs to the row (the values found
    in it), so its size is bounded by the row."""
    return F.get(F.transform(F.array(prepared(mapping)), lambda p: replace_prepared(text, p)), F.lit(0))


def quoted(value: Column) -> Column:
    """A pattern that matches the value and nothing else."""
    return F.concat(
        F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )


def mask_columns(df: DataFrame, columns: list[str], mapping: str) -> DataFrame:
    """`replace_all` on several columns of a table; column names stay as they are."""
    held = df.withColumn("_prepared", prepared(F.col(mapping)))
    return held.withColumns({c: replace_prepared(F.col(f"`{c}`"), F.col("_prepared")) for c in columns}).drop("_prepared")


def mask_nested(value: Column, dtype: T.DataType, mapping: Column) -> Column:
    """`replace_all` on the string and number leaves of a nested value; keys, booleans and nulls
    stay. Number leaves become strings, since a number that is a detected value gives way to its
    token. Built from the schema, so it is an ordinary expression."""
    return F.get(F.transform(F.array(prepared(mapping)), lambda p: _mask_nested(value, dtype, p)), F.lit(0))


def _mask_nested(value: Column, dtype: T.DataType, p: Column) -> Column:
    if isinstance(dtype, T.StringType):
        return replace_prepared(value, p)
    if isinstance(dtype, T.NumericType):
        return replace_prepared(value.cast("string"), p)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _mask_nested(x, dtype.elementType, p))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, v: _mask_nested(v, dtype.valueType, p))
    if isinstance(dtype, T.StructType):
        fields = [
            _mask_nested(value.getField(f.name), f.dataType, p).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


# -- span form: only the detected positions ------------------------------------

def splice(text: str, spans: str) -> str:
    """SQL expression: the text with each span (start, end, token) replaced; spans must not
    overlap and come sorted. Nothing but the detected positions changes, and tokens are never
    searched again."""
    b = blocks(text)
    before = f"CASE WHEN i = 0 THEN 0 ELSE element_at({spans}, i).`end` END"
    gap = slice_text("b", "x.at", "(x.s.start - x.at)")
    rest = slice_text("b", f"element_at({spans}, -1).`end`", f"length({text})")
    parts = (
        f"transform(transform({spans}, (s, i) -> struct(s AS s, {before} AS at)), "
        f"x -> concat({gap}, x.s.token))"
    )
    # one-element array: gives the blocks a name
    whole = f"transform(array({b}), b -> concat(array_join({parts}, ''), {rest}))[0]"
    return f"CASE WHEN size({spans}) > 0 THEN {whole} ELSE {text} END"


def unit_tokens(
    detected: DataFrame, vault: DataFrame, keys: list[str], file: str = "file_id"
) -> DataFrame:
    """Spans with tokens, collected per unit of text: (keys, spans, n_rows).

    Only spans are shuffled, not texts. `vault` needs value, token and n_found per file;
    values that occur very often are joined by broadcast (see `lookup_join`). A unit's list
    is bounded by its own text; copies of a unit that share its id add nothing to it.
    """
    all_keys = list(dict.fromkeys([file, *keys]))
    spans = detected.select(*all_keys, "start", "end", "value")
    joined = lookup_join(spans, vault, [file, "value"], "n_found", ["token"])
    return joined.groupBy(*all_keys).agg(
        F.collect_set(F.struct("start", "end", "token", "value")).alias("spans"),
        F.count("*").alias("n_rows"),
    )


def mask_texts(
    units: DataFrame, tokens: DataFrame, keys: list[str], text: str = "text",
    out: str = "masked",
) -> DataFrame:
    """Masked text of every unit. Units without detections keep their text; where a key is null,
    detections are replaced by their type in brackets.

    `units` carries the `detections` column; only units that have any take part in the join.
    `tokens` comes from `unit_tokens`, best written to a table first. Units that exist in very
    many copies under one id are no hot key (see `lookup_join`).
    """
    named = has_keys(keys)
    clean = units.where(F.size("detections") == 0).withColumn(out, F.col(text))
    found = units.where(F.size("detections") > 0)
    dirty = lookup_join(found.where(named), tokens, keys, "n_rows", ["spans"])
    nameless = spliced_by_type(found.where(~named), text, out)
    ordered = dirty.withColumn("spans", F.sort_array("spans"))
    spliced = ordered.withColumn(out, F.expr(splice(text, "spans"))).drop("spans")
    return clean.unionByName(spliced).unionByName(nameless)


def has_keys(keys: list[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def spliced_by_type(units: DataFrame, text: str, out: str) -> DataFrame:
    """No vault entry can be found by a null id: the value gives way to its type."""
    by_type = F.sort_array(F.transform("detections", lambda d: F.struct(
        d["start"].alias("start"), d["end"].alias("end"),
        F.concat(F.lit("["), d["pii_type"], F.lit("]")).alias("token"), d["value"].alias("value"))))
    return units.withColumn("_spans", by_type).withColumn(
        out, F.expr(splice(text, "_spans"))).drop("_spans")


# -- dictionary form over whole files -------------------------------------------

def mask_by_file(
    texts: DataFrame, vault: DataFrame, keys: list[str], file: str = "file_id",
    text: str = "text", out: str = "masked",
) -> DataFrame:
    """Replace every occurrence of every value of the file in each of its texts.

    Each text receives only the values it contains, so no file-wide dictionary is ever
    collected. Values are looked for in the original text only. `vault` has one row per file and
    value and is best a written table. Where a key is null no vault entry can be found: there the
    `detections`, if the table has them, are replaced by their type in brackets.
    """
    all_keys = list(dict.fromkeys([file, *keys]))
    named = has_keys(all_keys)
    kept = texts.where(named)
    hits = find_values(kept, vault, keys, file, text, ["token"])
    per_text = hits.groupBy(*all_keys).agg(F.collect_set(F.struct("value", "token")).alias("_mapping"))
    found = counted_join(kept, per_text, all_keys, ["_mapping"], "left")
    masked = found.withColumn(out, F.when(F.col("_mapping").isNull(), F.col(text)).otherwise(
        replace_all(F.col(text), F.col("_mapping")))).drop("_mapping")
    nameless = texts.where(~named)
    by_type = spliced_by_type(nameless, text, out) if "detections" in texts.columns else (
        nameless.withColumn(out, F.col(text)))
    return masked.unionByName(by_type)


def leaks(
    masked: DataFrame, values: DataFrame, keys: list[str], file: str = "file_id",
    text: str = "masked",
) -> DataFrame:
    """(file, keys, value): values of its file that a text still contains outside of tokens; must be
    empty. What happens to stand inside a token's letters is no value."""
    outside = masked.withColumn(text, F.regexp_replace(text, TOKEN_PATTERN, "\0"))
    return find_values(outside, values, keys, file, text)


# -- back to the original --------------------------------------------------------

TOKEN_PATTERN = f"(?:{'|'.join(C.TOKEN_PREFIX.values())})_[{LETTERS}]{{{TOKEN_DIGITS}}}"


def detokenise(
    masked: DataFrame, revealed: DataFrame, keys: list[str], file: str = "file_id",
    text: str = "masked", out: str = "restored",
) -> DataFrame:
    """Put the values back. `revealed` maps tokens of a file to values.

    Texts without anything that looks like a token take no part in the joins.
    """
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)))
    all_keys = list(dict.fromkeys([file, *keys]))
    marked = masked.withColumn("_tokens", found)
    plain = marked.where(F.size("_tokens") == 0).withColumn(out, F.col(text)).drop("_tokens")
    coded = marked.where(F.size("_tokens") > 0)
    rows = coded.select(*all_keys, F.explode("_tokens").alias("token"))
    known = salted_join(rows, revealed.select(file, "token", "value"), [file, "token"], keys)
    per_text = known.groupBy(*keys).agg(
        F.collect_set(F.struct(F.col("token").alias("value"), F.col("value").alias("token")))
        .alias("_back")
    )
    restored = (
        coded.join(per_text, keys, "left")
        .withColumn(out, F.when(F.col("_back").isNull(), F.col(text)).otherwise(
            replace_all(F.col(text), F.col("_back"))))
        .drop("_back", "_tokens")
    )
    return plain.unionByName(restored)
