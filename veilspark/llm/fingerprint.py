"""Document fingerprints as invertible Bloom lookup sketches.

A text is the set of digests of its paragraphs (lines; long lines are cut at the first sentence
end after 128 characters). Each digest goes into 4 of 32 cells, one per row of eight; a cell
holds a count, the xor of its digests and the xor of their checks. Two sketches subtract cell
by cell: what both texts share vanishes, and cells with one digest left are peeled off until
the differing digests are known. If peeling gets stuck, both texts are sketched larger: digests
are dealt by their low bits into more and more sections of 32 cells, until all sections peel.
From the second larger size on, each size also deals the cells anew. What no size peels is
counted exactly, from the two sets of digests.

Likeness of two texts: shared digests over all digests, from the two sizes and the peeled
difference. The printed fingerprint is the smallest sketch.

Everything is built-in expressions over one row: no Python on the executors, no group of rows.
The next document in id order comes from a window over ranges of ids; ranges hold a few
hundred documents, and the first document of each range is also sent to the range before it.

Cases. Null or empty text: no paragraphs, an all-zero fingerprint; two such texts are alike
(1), one such text and another are not (0). Equal ids are ordered by the hash of their text. Null ids come
last. Repeated rows have equal fingerprints. A single document is its own next one. Empty
table: empty result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import take_columns

ROWS, WIDTH = 4, 8
CELLS = ROWS * WIDTH
PER_SECTION = 8  # digests of both texts that a section of a larger sketch should hold
PEELS = 12  # rounds of peeling in one sketch
LEVELS = 12  # sizes tried before the exact count; each has twice the sections of the one before
RANGE = 400  # documents in a range of ids
MAX_RANGES = 100_000  # bounds what the driver keeps; ranges grow beyond

PARAGRAPH = r"[^\\n]{1,128}+[^\\n.!?]*+[.!?]*+"
CELL = "struct<n:int,x:bigint,h:bigint>"


def cell_bits(k: str) -> str:
    """SQL: the four cell numbers of a digest as a bit mask of 32."""
    return " + ".join(
        f"shiftleft(1L, cast({r * WIDTH} + (shiftrightunsigned({k}, {24 + 8 * r}) & {WIDTH - 1}) AS int))"
        for r in range(ROWS)
    )


def digests(text: str) -> str:
    """SQL: distinct paragraph digests with their cells, as array<struct<k,h,c>>; c packs the
    four cell numbers as a bit mask of 32."""
    return (
        f"transform(array_distinct(transform(regexp_extract_all({text}, '{PARAGRAPH}', 0), p -> xxhash64(p))), "
        f"k -> struct(k AS k, xxhash64(k) AS h, {cell_bits('k')} AS c))"
    )


def anew(keys: str) -> str:
    """SQL: digests with the cells that `level` deals them."""
    return (
        f"transform(transform({keys}, e -> struct(e.k AS k, e.h AS h, xxhash64(e.k, level) AS m)), "
        f"e -> struct(e.k AS k, e.h AS h, {cell_bits('e.m')} AS c))"
    )


def sketch(keys: str) -> str:
    """SQL: the 32 cells of an array of digests."""
    return f"""transform(sequence(0, {CELLS - 1}), i -> aggregate(
      filter({keys}, e -> (shiftrightunsigned(e.c, i) & 1L) = 1L),
      struct(0 AS n, 0L AS x, 0L AS h),
      (a, e) -> struct(a.n + 1 AS n, a.x ^ e.k AS x, a.h ^ e.h AS h)))"""


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> struct(p.n - q.n AS n, p.x ^ q.x AS x, p.h ^ q.h AS h))"


def peel(cells: str, dealt: str = "c.x") -> str:
    """SQL: how many digests the difference of two sketches holds, null if it does not peel.
    `dealt` is what the cells of the digest c.x were taken from."""
    bits = cell_bits(dealt)
    # a cell with one digest: the check of its xor is its xor of checks
    pure = (
        "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND xxhash64(c.x) = c.h), "
        f"c -> struct(c.n AS n, c.x AS x, c.h AS h, {bits} AS c)))"
    )
    without = """transform(s.cells, (c, i) -> aggregate(
        filter(found, p -> (shiftrightunsigned(p.c, i) & 1L) = 1L), c,
        (a, p) -> struct(a.n - p.n AS n, a.x ^ p.x AS x, a.h ^ p.h AS h)))"""
    step = f"""element_at(transform(array({pure}), found -> CASE WHEN size(found) = 0
        THEN struct(s.cells AS cells, s.d AS d, true AS stuck)
        ELSE struct({without} AS cells, s.d + size(found) AS d, false AS stuck) END), 1)"""
    return f"""aggregate(sequence(1, {PEELS}),
      struct({cells} AS cells, 0 AS d, false AS stuck),
      (s, r) -> CASE WHEN s.stuck THEN s ELSE {step} END,
      s -> CASE WHEN forall(s.cells, c -> c.n = 0 AND c.x = 0L AND c.h = 0L) THEN s.d END)"""


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: the number of digests in one of two texts only. First from the ready sketches,
    then from larger and larger ones, and exactly if none of them peels."""
    small = peel(minus(cells_a, cells_b))
    larger = _larger(a, b, a, b, "c.x")
    again = _larger(a, b, anew(a), anew(b), "xxhash64(c.x, level)")
    keys_a, keys_b = f"transform({a}, e -> e.k)", f"transform({b}, e -> e.k)"
    exact = f"size(array_except({keys_a}, {keys_b})) + size(array_except({keys_b}, {keys_a}))"
    return f"""aggregate(sequence(0, {LEVELS}), cast(null AS int),
      (d, level) -> CASE WHEN d IS NOT NULL THEN d
        WHEN level = 0 THEN {small} WHEN level = 1 THEN {larger} ELSE {again} END,
      d -> coalesce(d, {exact}))"""


def _larger(a: str, b: str, keys_a: str, keys_b: str, dealt: str) -> str:
    """SQL: the difference of two texts from the sections of size `level`, null if one does
    not peel. `keys_a` and `keys_b` are the digests of a and b with the cells of this size."""
    section_a = "filter(part.a, e -> (e.k & mask) = g)"
    section_b = "filter(part.b, e -> (e.k & mask) = g)"
    one = peel(minus(sketch(section_a), sketch(section_b)), dealt)
    # digests are dealt in two steps, so that a long text is not filtered once per section
    coarse = "cast(sqrt(mask + 1) AS bigint)"
    low = f"(cast(pow(2, floor(log2({coarse}))) AS bigint) - 1L)"
    part_keys = "filter({side}, e -> (e.k & low) = v)"
    parts = (
        f"transform(sequence(0L, low), v -> struct(v AS v, {part_keys.format(side='side.a')} AS a, "
        f"{part_keys.format(side='side.b')} AS b))"
    )
    per_part = (
        "aggregate(transform(sequence(part.v, mask, low + 1L), g -> " + one + "), 0, (t, d) -> t + d)"
    )
    # the digests are bound once, not for each part
    sides = f"array(struct({keys_a} AS a, {keys_b} AS b))"
    each = f"element_at(transform({sides}, side -> {parts}), 1)"
    whole = (
        f"element_at(transform(array({low}), low -> aggregate(transform({each}, part -> {per_part}), 0, (t, d) -> t + d)), 1)"
    )
    first = f"greatest(0, cast(ceil(log2((size({a}) + size({b})) / {PER_SECTION}.0)) AS int))"
    mask = f"(shiftleft(1L, cast({first} + level AS int)) - 1L)"
    return f"element_at(transform(array({mask}), mask -> {whole}), 1)"


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: shared over all digests of two texts."""
    d = difference(a, b, cells_a, cells_b)
    return f"""CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE element_at(transform(array({d}),
      d -> (size({a}) + size({b}) - d) / cast(size({a}) + size({b}) + d AS double)), 1) END"""


def printed(cells: str) -> str:
    """SQL: a sketch as text: count, xor and 16 bits of the check of each cell."""
    cell = (
        "concat(lpad(hex(c.n & 65535), 4, '0'), lpad(hex(c.x), 16, '0'), lpad(hex(c.h & 65535L), 4, '0'))"
    )
    return rf"translate(base64(unhex(array_join(transform({cells}, c -> {cell}), ''))), '\r\n', '')"


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with `next_text`, the text of the next row by id; after the last
    comes the first. One shuffle of the texts."""
    ids = rows.select(F.col("doc_id").cast("double").alias("_at")).where("_at IS NOT NULL")
    ranges = min(MAX_RANGES, ids.count() // RANGE)
    cuts = ids.approxQuantile("_at", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    bucketizer = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep")
    placed = bucketizer.transform(rows.withColumn("_at", F.col("doc_id").cast("double")))
    # null ids make a range of their own, after all others
    placed = placed.withColumn(
        "_range", F.coalesce(F.col("_range").cast("int"), F.lit(len(splits)))).drop("_at")

    # one row per range, so at most MAX_RANGES + 1 rows
    heads = placed.groupBy("_range").agg(F.min("doc_id").alias("_head"))
    cycle = W.orderBy("_range")
    last = F.max("_range").over(cycle.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("_range", "_head", F.coalesce(F.lag("_range").over(cycle), last).alias("_before"))
    placed = placed.join(
        F.broadcast(heads.withColumnRenamed("_range", "_own")),
        (F.col("_range") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    copies = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))))
    copies = copies.otherwise(F.array(
        F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")),
        F.struct(F.col("_before").alias("r"), F.lit(1).alias("copy"))))
    placed = placed.select("doc_id", "text", F.explode(copies).alias("_c"))
    order = W.partitionBy("_c.r").orderBy("_c.copy", F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return (
        placed.withColumn("next_text", F.lead("text").over(order))
        .where("_c.copy = 0").select("doc_id", "text", "next_text")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    of every row; the edited text is the document with its last half replaced by the beginning
    of the next document."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)
    rows = with_next(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.expr(
        "concat(left(text, cast(n_chars - n_chars div 2 AS int)), left(next_text, cast(n_chars div 2 AS int)))"))
    keyed = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(digests("text")).alias("a"), F.expr(digests("edited")).alias("e"),
        F.expr(digests("next_text")).alias("n"))
    sketched = keyed.select(
        "*", F.expr(sketch("a")).alias("ca"), F.expr(sketch("e")).alias("ce"), F.expr(sketch("n")).alias("cn"))
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256",
        F.expr(printed("ca")).alias("fingerprint"), F.expr(printed("ce")).alias("edited_fingerprint"),
        F.expr(likeness("a", "e", "ca", "ce")).alias("near_edited"),
        F.expr(likeness("a", "n", "ca", "cn")).alias("near_next"))
