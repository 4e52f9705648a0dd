"""Files whose quotes hold the separator, over many splits; statements of very many tuples."""

import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.sources import sqldump, tables


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dump(seed, n):
    """Statements with literals that hold separators, quotes of the other kind, doubled quotes and
    comment marks; comments that hold quotes."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        body = "".join(rng.choice(["word ", ";\n", "''", '"', "--", "/*", "\n", ";", "9"]) for _ in range(rng.randint(0, 60)))
        quoted = f"'{body}'" if rng.random() < 0.7 else '"' + body.replace('"', "'") + '"'
        kind = rng.random()
        if kind < 0.15:
            out.append(f"-- it's number {k};\n")
        elif kind < 0.25:
            out.append(f"/* don't;\n mind {k} */")
        out.append(f"INSERT INTO t VALUES ({k}, {quoted}, 'z');\n")
    return "".join(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_torn_literals_over_many_splits(spark, tmp_path, small_splits, seed):
    (tmp_path / "a.sql").write_text(dump(seed, 60))
    (tmp_path / "b.sql").write_text("".join(f"INSERT INTO t VALUES ({k}, 'plain');\n" for k in range(40)))
    (tmp_path / "c.sql").write_text("INSERT INTO t VALUES ('" + "long;\n" * 300 + "');\nINSERT INTO t VALUES (1);\n")
    (tmp_path / "d.sql").write_text("INSERT INTO t VALUES ('never closed;\nINSERT INTO t VALUES (2);\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    def read(whole):  # a line comment that ends in ";" may be a statement or part of the next one
        rows = sqldump.read_dump(spark, str(tmp_path), whole)
        rows = rows.withColumn("statement", sqldump.without_comments(F.col("statement")))
        return sorted((r.file_id, r.statement) for r in rows.where("statement != ''").collect())

    got, whole = read(False), read(True)

    def clean(rows):
        return [r for r in rows if r[0] != "d.sql"]

    assert clean(got) == clean(whole) and sum(f == "a.sql" for f, _ in got) >= 60
    assert any("long;\n" * 300 in s for _, s in got)
    # a literal that never closes runs to the end of its file
    assert [s for f, s in got if f == "d.sql"] and "(2)" in " ".join(s for f, s in got if f == "d.sql")


def test_states(spark):
    cases = {"a 'b' c": [0, 1, 2, 3], "a 'b": [1, 0, 2, 3], 'x " y': [2, 1, 0, 3], "-- it's\n": [0, 0, 2, 3],
             "/* it's": [3, 0, 2, 3], "x */ 'y": [1, 0, 2, 1], "": [0, 1, 2, 3], "'it''s'": [0, 1, 2, 3],
             "'a \"b' \"": [2, 0, 0, 3]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", sqldump.end_states(F.col("t")).alias("s")).collect()}
    for text, want in cases.items():
        assert got[text][0] == want[0], text
    assert got["-- it's\n"] == [0, 0, 2, 3] and got["x */ 'y"][3] == 1


def test_tuples(spark):
    cases = {
        "INSERT INTO t VALUES (1, 'a'), (f(g(2)), 'b')": ["1, 'a'", "f(g(2)), 'b'"],
        "INSERT INTO t VALUES ('a :(', '9876543210'), (2, 'x)')": ["'a :(', '9876543210'", "2, 'x)'"],
        "INSERT INTO t VALUES " + "(" * 12 + "7" + ")" * 12: ["(" * 11 + "7" + ")" * 11],
        "INSERT INTO t VALUES": [], "INSERT INTO t SELECT 1": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = df.select("s", sqldump.insert_tuples(F.col("s"), quotes=True).alias("t")).collect()
    assert {r.s: r.t for r in got} == cases
    plain = df.where("s NOT LIKE '%:(%'").select("s", sqldump.insert_tuples(F.col("s")).alias("t")).collect()
    assert all(r.t == cases[r.s] for r in plain)


def test_very_many_tuples_take_linear_time(spark):
    def seconds(n):
        tuples = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(
            F.lit("("), k.cast("string"), F.lit(", 'it''s name', upper('x'), 9876543210)"))), ", ")
        statements = spark.range(1).select("id", F.concat(F.lit("INSERT INTO t (a, b, c, d) VALUES "), tuples).alias("statement"))
        start = time.perf_counter()
        assert sqldump.insert_literals(statements, ["id"]).count() == 4 * n
        assert sqldump.insert_cells(statements, ["id"]).count() == 4 * n
        return time.perf_counter() - start

    seconds(1000)
    short, long = min(seconds(8000) for _ in range(2)), min(seconds(32_000) for _ in range(2))
    assert long < 5 * max(short, 0.5)


def test_csv_over_many_splits(spark, tmp_path, small_splits):
    """Cells with line breaks, quotes and separators, rows with cells too many and too few."""
    rng = random.Random(5)
    rows = [["".join(rng.choice(["a", ",", "\n", '"', "é", " "]) for _ in range(rng.randint(0, 30)))
             for _ in range(rng.choice([1, 2, 3, 3, 3, 5]))] for _ in range(200)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows([["x", "y", "z"], *rows])
    (tmp_path / "torn.csv").write_bytes(out.getvalue().encode())
    (tmp_path / "plain.csv").write_bytes(b"\xef\xbb\xbfx,y,z\n" + b"1,2,3\n\n" * 100)
    got = tables.read_csv(spark, str(tmp_path)).collect()
    assert [tuple(r)[1:] for r in got if r.file_id == "plain.csv"] == [("1", "2", "3", [])] * 100
    want = [(*[*r, "", "", ""][:3], r[3:]) for r in rows]
    assert sorted(tuple(r)[1:] for r in got if r.file_id == "torn.csv") == sorted(want)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    (tmp_path / "other.csv").write_bytes(b"x,y\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_csv(spark, str(tmp_path))
