"""Layer 2: people and places in running text.

The built-in recogniser is a rule of thumb: two or three capitalised words are a person
candidate, known place names a place candidate. A trained model can take its place through
`DetectConfig.ner_fn`; it then runs as an Arrow-batched UDF next to the native steps, on
pieces of at most 100,000 characters. Functions on text take and return SQL text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.spans import cut, locate, slice_text
from ..functions.text import literal, rlike, strip

# The look-ahead rejects most positions on one character.
PERSON = "(?=[A-Z])" + C.PERSON_SHAPE
PLACE = r"(?=[A-Z])\b(?:" + "|".join(C.PLACES) + r")\b"
ENTITIES = "array<struct<start:int,end:int,label:string>>"


def is_excluded(value: str) -> str:
    terms = ", ".join(map(literal, C.GEO_EXCLUSIONS))
    return f"(lower({strip(value)}) IN ({terms}))"


def is_dotted_path(value: str) -> str:
    path = rlike(value, r"^[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*\z")
    return f"(contains({value}, '.') AND {path})"


def is_person_shape(value: str) -> str:
    letters = rlike(f"regexp_replace({value}, '[ .-]', '')", r"^\p{L}+\z")
    return (
        f"(length({value}) >= 2 AND {letters} "
        f"AND (contains({value}, ' ') OR length({value}) >= 4))"
    )


def is_place_shape(value: str) -> str:
    return f"(length({value}) >= 5)"


def acceptable(value: str, pii_type: str) -> str:
    shape = is_person_shape(value) if pii_type == "PERSON_NAME" else is_place_shape(value)
    return f"(NOT {is_excluded(value)} AND NOT {is_dotted_path(value)} AND {shape})"


def find_people(text: str) -> str:
    return cut(text, PERSON, rlike(text, "[a-z] [A-Z]"))


def find_places(text: str) -> str:
    return cut(text, PLACE)


def cue_spans(pieces: str, pii_type: str) -> str:
    return f"filter({locate(pieces)}, s -> {acceptable('s.value', pii_type)})"


def entity_column(text: Column, ner_fn: Callable, chunk: int = C.NER_CHUNK_CHARS) -> Column:
    """Run `ner_fn` on every text; one Arrow batch at a time, state kept per worker."""

    @F.pandas_udf(ENTITIES)
    def entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            return [
                {"start": at + s, "end": at + e, "label": label}
                for at in range(0, len(text or ""), chunk)
                for s, e, label in ner_fn(text[at:at + chunk])
            ]

        for texts in batches:
            yield texts.map(one)

    return entities(text)


def model_spans(text_blocks: str, entities: str, pii_type: str) -> str:
    """Spans of one kind from the model's output, after the same acceptance rules."""
    labels = "'PERSON'" if pii_type == "PERSON_NAME" else "'GPE', 'LOC', 'FAC'"
    value = strip(slice_text(text_blocks, "e.start", "(e.`end` - e.start)"))
    spans = (
        f"transform(filter({entities}, e -> e.label IN ({labels})), e -> "
        f"struct(e.start AS start, e.`end` AS `end`, {value} AS value))"
    )
    return f"filter({spans}, s -> {acceptable('s.value', pii_type)})"


def split_chunks(df: DataFrame, text: str = "text", chunk: int = C.NER_CHUNK_CHARS) -> DataFrame:
    """Long texts as rows of at most `chunk` characters, with their offset."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(chunk)))
    return df.withColumn("chunk_offset", at).withColumn(
        text, F.substring(F.col(text), F.col("chunk_offset") + 1, F.lit(chunk))
    )
