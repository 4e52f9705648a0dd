"""Statements of SQL dumps, and the literals of INSERT and UPDATE statements.

Dumps are cut at ";\\n", so one file is read by many tasks. A literal may hold that separator; then
a piece ends inside it, and `torn` puts its pieces together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EDGES
from . import torn

_COMMENT = r"--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
# A statement: stretches without ";" and quotes, comments, quoted literals, or a quote left alone.
# Possessive, so that long statements need no deep recursion.
STATEMENT = rf"""(?s)(?:[^;'"/-]++|{_COMMENT}|'[^']*+'|"[^"]*+"|['"/-])++"""

# What is left of a piece without comments and quoted literals; what begins first in it is open.
_CLOSED = rf"""(?s){_COMMENT}|'[^']*+'|"[^"]*+\""""

OUTSIDE, SINGLE, DOUBLE, COMMENT = range(4)


def read_dump(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Statements of dump files: (file_id, statement).

    Files are cut at ";\\n"; several statements on one line are then separated outside quotes, and
    pieces of a literal that holds ";\\n" are joined again. Quotes in comments are no quotes.
    `whole_files` reads one file per task instead.
    """
    if whole_files:
        raw = spark.read.text(path, wholetext=True)
        return split_statements(raw.select(F.col("_metadata.file_name").alias("file_id"), "value"), "value")
    pieces = torn.read_pieces(spark, path, ";\n", end_states)
    return split_statements(torn.rejoined(pieces, ";\n").select("file_id", "value"), "value")


def end_states(text: Column) -> Column:
    """The state after a piece, for each state before it, as an array."""
    def from_outside(t):
        first = F.regexp_extract(F.regexp_replace(t, _CLOSED, ""), r"""['"]|/\*""", 0)
        return F.when(first == "'", SINGLE).when(first == '"', DOUBLE).when(first == "/*", COMMENT).otherwise(OUTSIDE)

    def from_inside(state, end):
        at = F.instr(text, end)
        return F.when(at == 0, state).otherwise(from_outside(F.substring(text, at + len(end), F.length(text))))

    return F.array(from_outside(text), from_inside(SINGLE, "'"), from_inside(DOUBLE, '"'), from_inside(COMMENT, "*/"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def without_comments(statement: Column) -> Column:
    """The statement without the comments before it."""
    return F.regexp_replace(statement, r"(?s)\A(?:\s+|--[^\n]*+(?:\n|\z)|/\*.*?\*/)+", "")


def split_statements(df: DataFrame, column: str) -> DataFrame:
    """Separate statements at semicolons outside quotes; blanks are dropped."""
    pieces = F.regexp_extract_all(column, F.lit(STATEMENT), F.lit(0))
    rows = df.withColumn("statement", F.explode(pieces)).drop(column)
    return rows.withColumn("statement", strip(F.col("statement"))).where(F.col("statement") != "")


def kind(statement: Column) -> Column:
    """INSERT, UPDATE or null."""
    head = F.upper(F.substring(statement, 1, 6))
    return F.when(head.isin("INSERT", "UPDATE"), head)


def _unquote(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^['\"]+|['\"]+$", "")


def _after(statement: Column, word: str) -> Column:
    """Text after the first occurrence of a word, ignoring case; null if absent."""
    at = F.instr(F.upper(statement), word)
    return F.when(at > 0, F.substring(statement, at + len(word), F.length(statement)))


def _nested(inner: str, depth: int) -> str:
    """A pattern of what may stand between parentheses, with up to `depth` levels inside it."""
    level = f"(?:{inner})*+"
    for _ in range(depth):
        level = rf"(?:{inner}|\({level}\))*+"
    return rf"(?s)\(({level})\)"


NESTING = 8
_TUPLE = _nested(r"[^()]++", NESTING)
_QUOTED_TUPLE = _nested(r"""[^()'"]++|'[^']*+'|"[^"]*+\"""", NESTING)


def insert_tuples(statement: Column, quotes: bool = False) -> Column:
    """Array of the texts inside the outermost parentheses after VALUES, at any nesting; with
    `quotes`, parentheses inside quoted literals do not count.

    One match per tuple, linear in the text. Where the pattern leaves a parenthesis over (deeper
    nesting, or none that closes), the text is walked parenthesis by parenthesis instead.
    """
    after = _after(statement, "VALUES")

    def found(pattern, otherwise):
        rest = F.regexp_replace(F.regexp_replace(after, pattern, ""), _CLOSED if quotes else r"(?!)", "")
        return F.when(rest.rlike("[()]"), otherwise).otherwise(
            F.regexp_extract_all(after, F.lit(pattern), F.lit(1)))

    plain = found(_TUPLE, _walked_tuples(after))
    tuples = found(_QUOTED_TUPLE, plain) if quotes else plain
    return F.coalesce(tuples, F.array().cast("array<string>"))


def _walked_tuples(text: Column) -> Column:
    """One pass over parentheses and the stretches between them keeps the depth, the open tuple and
    the finished ones."""
    pieces = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("open"),
        F.array().cast("array<string>").alias("rows"),
    )

    def step(acc, p):
        depth = acc["depth"] + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)
        opens = (p == "(") & (depth == 1)
        closes = (p == ")") & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(opens | closes, "").when(depth >= 1, F.concat(acc["open"], p))
            .otherwise(acc["open"]).alias("open"),
            F.when(closes, F.concat(acc["rows"], F.array(acc["open"])))
            .otherwise(acc["rows"]).alias("rows"),
        )

    return F.aggregate(
        F.coalesce(pieces, F.array().cast("array<string>")), start, step, lambda acc: acc["rows"]
    )


def insert_literals(statements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, pos, value) for every literal of every INSERT tuple.

    Tuples are split on every comma, also inside quotes; empty values are dropped.
    """
    inserts = statements.where(kind(F.col("statement")) == "INSERT")
    tuples = inserts.select(*keys, F.posexplode(insert_tuples(F.col("statement"))).alias("row_no", "t"))
    cells = tuples.select(*keys, "row_no", F.posexplode(F.split("t", ",", -1)).alias("pos", "v"))
    return cells.select(*keys, "row_no", "pos", _unquote(F.col("v")).alias("value")).where(
        F.col("value") != ""
    )


def insert_cells(statements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, pos, label, value), aware of quotes and of the column list.

    A comma inside quotes does not split, and each value carries its column's name.
    """
    st = F.col("statement")
    inserts = statements.where(kind(st) == "INSERT")
    listed = F.regexp_extract(st, r"(?is)^INSERT\s+INTO\s+[^()]*?\(([^()]*)\)\s*VALUES", 1)
    names = F.transform(F.split(listed, ","), lambda c: F.regexp_replace(strip(c), "[`\"\\[\\]]", ""))
    tuples = inserts.select(
        *keys, names.alias("_names"), F.posexplode(insert_tuples(st, quotes=True)).alias("row_no", "t")
    )
    values = F.regexp_extract_all("t", F.lit(r"(?s)(?:'(?:[^']++|'')*+'|[^,']++|')++"), F.lit(0))
    cells = tuples.select(*keys, "row_no", "_names", F.posexplode(values).alias("pos", "v"))
    return cells.select(
        *keys, "row_no", "pos", F.get("_names", "pos").alias("label"),
        F.replace(_unquote(F.col("v")), F.lit("''"), F.lit("'")).alias("value"),
    ).where(F.col("value") != "")


def update_literals(statements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, value) for the right-hand sides between SET and WHERE."""
    st = F.col("statement")
    upper = F.upper(st)
    set_at, where_at = F.instr(upper, "SET"), F.instr(upper, "WHERE")
    end = F.when(where_at > 0, where_at).otherwise(F.length(st) + 1)
    # nothing is left when WHERE comes first
    clause = F.substring(st, set_at + 3, F.greatest(end - set_at - 3, F.lit(0)))
    updates = statements.where((kind(st) == "UPDATE") & (set_at > 0))
    parts = updates.select(*keys, F.posexplode(F.split(clause, ",", -1)).alias("pos", "a"))
    value = _unquote(F.regexp_extract("a", r"(?s)^[^=]*=(.*)\z", 1))
    return parts.where(F.col("a").contains("=")).select(*keys, "pos", value.alias("value")).where(
        F.col("value") != ""
    )


def update_cells(statements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, label, value) for the assignments between SET and WHERE, aware of quotes: each
    value with its column's name."""
    st = F.col("statement")
    clause = F.regexp_extract(st, r"""(?is)\bSET\b((?:[^'"]|'[^']*+'|"[^"]*+")*?)(?:\bWHERE\b|\z)""", 1)
    parts = F.regexp_extract_all(clause, F.lit(r"""(?s)(?:[^,'"]++|'(?:[^']++|'')*+'|"[^"]*+"|['"])++"""), F.lit(0))
    updates = statements.where(kind(st) == "UPDATE").select(*keys, F.posexplode(parts).alias("pos", "a"))
    name = F.regexp_replace(strip(F.regexp_extract("a", r"(?s)^([^=]*)=", 1)), "[`\"\\[\\]]", "")
    value = _unquote(F.regexp_extract("a", r"(?s)^[^=]*=(.*)\z", 1))
    return updates.where(F.col("a").contains("=")).select(
        *keys, "pos", name.alias("label"), F.replace(value, F.lit("''"), F.lit("'")).alias("value")
    ).where(F.col("value") != "")


def literals(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Literals of all INSERT and UPDATE statements: (keys, value)."""
    return insert_literals(statements, keys).select(*keys, "value").unionByName(
        update_literals(statements, keys).select(*keys, "value")
    )
