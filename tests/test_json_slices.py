"""JSON files in slices: the same leaves as of the whole text, and no row that carries a large file."""

import json

import pytest

from veilspark.sources import chunks, pieces
from veilspark.sources.nested import _Number, _walk

ODD = [
    "[]", " [ ] \n", "[1,]", "[1 2]", "[1] x", "[1", "[,1]", "[1,[2,{\"a\": [3, null]}]]", '{"a": [1, 2], "b": {"c": "x"}}',
    '["a,b]", "\\"", {"k": "é😀"}, 1.50, -2e5, true, false, null, NaN]', "7", '"x"', "", "﻿[1]", '[{"a": 1, "a": 2}]',
    "[" * 50_000, "[1" + ", 1" * 500 + "]",
]


def leaves(text):
    try:
        return _walk(json.loads(text, parse_int=_Number, parse_float=_Number)) if text else []
    except (ValueError, RecursionError):
        return []


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_slices_have_the_leaves_of_the_whole(size):
    for text in ODD:
        places = chunks.array_slices(text, size)
        parts = [text] if places is None else [f"[{text[a:b]}]" for a, b in places]
        assert [x for p in parts for x in leaves(p)] == leaves(text), text[:40]


def test_units_of_a_large_array_are_numbered_and_no_row_carries_it(spark):
    records = [{"name": f"n{i}", "in": {"phone": i}, "long": "x" * 100} for i in range(20_000)]
    files = spark.createDataFrame(
        [("a.json", "json", json.dumps(records).encode()), ("b.json", "json", b'{"k": [1, {"m": "v"}]}'), ("c.json", "json", b"[1,]")],
        "file_id string, file_type string, content binary")
    longest = chunks.json_slices(files).selectExpr("max(length(_text))").first()[0]
    assert longest < 2 * chunks.JSON_SLICE
    rows = pieces.units(files).orderBy("file_id", "position").collect()
    assert [(r.label, r.text) for r in rows if r.file_id == "a.json"] == [(x[1], x[2]) for x in leaves(json.dumps(records))]
    assert [r.unit_id for r in rows if r.file_id == "a.json"] == [str(i) for i in range(60_000)]
    assert [(r.position, r.label, r.text) for r in rows if r.file_id == "b.json"] == [(0, "k", "1"), (1, "m", "v")]
    assert not [r for r in rows if r.file_id == "c.json"]
