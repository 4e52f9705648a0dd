"""JSON values of any shape: leaves level by level, and masked values written back."""

import json

from pyspark.sql import functions as F

from veilspark.sources import nested

VALUES = [
    '{"a": {"phone": "9876543210"}, "n": 12, "ok": true, "no": null}', '{"a": "x"}', "[1]", '"alone"', "null", None,
    '{"list": [{"k": 1}, 5, ["q", {"deep": [[{"x": "y"}]]}]], "": "empty key"}', "[[{\"k\": 1}], [[[5]]]]", "{}", "[]", "7",
    '{"a.b": {"c": "dotted"}}',
]


def leaves(node, path="", label=""):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from leaves(v, f"{path}.{k}" if path else k, k)
    elif isinstance(node, list):
        for v in node:
            yield from leaves(v, path + "[]", label)
    elif node is not None:
        yield path, label, str(node).lower() if isinstance(node, bool) else str(node), isinstance(node, str)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, j string").select("id", "j", F.parse_json("j").alias("v"))


def test_leaves_of_mixed_shapes(spark):
    got = nested.variant_leaves(frame(spark, VALUES), "v", ["id"])
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = [(k, *leaf) for k, t in enumerate(VALUES) if t for leaf in leaves(json.loads(t))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 12
    assert nested.variant_leaves(frame(spark, VALUES).limit(0), "v", ["id"]).collect() == []


def test_masked_values_of_any_shape(spark):
    texts = ['{"p": 9876543210, "9876543210": ["x9876543210y", {"q": "a \\"b\\" 9876543210"}], "r": 1.5e3, "t": true}',
             '"9876543210"', "9876543210", "[]", "null", '{"a": "\\u0939 9876543210 \\n"}', None]
    mapping = F.array(F.struct(F.lit("9876543210").alias("value"), F.lit("PHONE_A").alias("token")),
                      F.struct(F.lit('a "b"').alias("value"), F.lit("N_B").alias("token")))
    df = frame(spark, texts)
    rows = df.select("id", "j", F.to_json(nested.mask_variant(F.col("v"), mapping)).alias("m"),
                     nested.mask_json(F.col("j"), mapping).alias("t")).collect()

    def masked(node):
        if isinstance(node, dict):
            return {k: masked(v) for k, v in node.items()}
        if isinstance(node, list):
            return [masked(v) for v in node]
        text = str(node) if isinstance(node, (int, str)) and not isinstance(node, bool) else None
        if text and ("9876543210" in text or 'a "b"' in text):
            return text.replace("9876543210", "PHONE_A").replace('a "b"', "N_B")
        return node

    for r in rows:
        if r.j is None:
            assert r.m is None and r.t is None
        else:
            assert json.loads(r.m) == json.loads(r.t) == masked(json.loads(r.j))
    first = next(r for r in rows if r.id == 0)
    assert '"9876543210": [' in first.t and "1.5e3" in first.t  # keys, blanks and numbers as they were written
