"""Secrets, told apart from copied examples by who owns them.

Patterns propose candidates: three base kinds, which are always reported, and kinds of this
method, which are reported only if they look live and few own them. Ownership is counted over
the whole corpus: candidate values travel as hashes, are reduced to distinct (hash, owner,
repository) before any count, and a value in the hands of at least `min_owners` owners and
`min_repositories` repositories is a widely copied example. Whether a value looks live is
judged on the whole of it, however long.

All of it is built-in expressions: no Python runs on the executors. A text is cut by a
pattern into gaps and matches; offsets are sums of their lengths in code points.

Cases. Null or empty text: no spans. A null owner or repository is a value of its own.
Repeated rows are judged alike and count as one repository. Several secrets on one place are
several spans. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import blocks, locate
from ..functions.text import literal
from .common import by_shuffle, stage, take_columns

# The base kinds, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, f"length(regexp_extract(s.value, {{assign}}, 2)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(s.value) >= 20"),
    # a match is a whole run of these letters, so short ones need not be matched and dropped
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", "true"),
)

# Formats of issued credentials, and any long token of mixed characters.
ADDED = (
    ("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "true"),
    ("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]++:[^\s:/@]{6,}+@", "true"),
    ("mixed", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+",
     "s.value rlike '[0-9]' AND s.value rlike '[a-z]' AND s.value rlike '[A-Z]'"),
)
KINDS = [kind for kind, _, _ in (*BASE, *ADDED)]

MIN_OWNERS = 3
MIN_REPOSITORIES = 3
# Bits per character of a value that is worth reporting, and words that mark a placeholder.
MIN_ENTROPY = 3.0
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test[_-]"

CANDIDATES = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(kind: int, pattern: str, keep: str) -> str:
    """Spans of one kind in `text`, as SQL."""
    java = literal(pattern)
    gaps = f"split(text, {java}, -1)"
    matches = f"regexp_extract_all(text, {java}, 0)"
    # gap, match, gap, …: a match after each gap but the last
    pieces = (
        f"flatten(zip_with({gaps}, {matches}, (g, m) -> "
        "CASE WHEN m IS NULL THEN array(g) ELSE array(g, m) END))"
    )
    item = f"struct(s.start AS start, {kind} AS kind, s.`end` AS `end`, s.value AS value)"
    spans = f"transform(filter({locate('pieces')}, s -> {keep.replace('{assign}', literal(ASSIGN))}), s -> {item})"
    # the pieces are bound once, as the only element of an array
    bound = f"flatten(transform(array({pieces}), pieces -> {spans}))"
    return f"CASE WHEN text RLIKE {java} THEN {bound} ELSE cast(array() AS {CANDIDATES}) END"


def entropy(value: str) -> str:
    """Bits per character of a string, as SQL. `value` is bound to a name. Characters are told
    apart block by block and each is counted over the whole string, so that a long one is not
    held as an array of its characters."""
    chars = f"array_distinct(flatten(transform({blocks(value)}, b -> array_distinct(split(b, '')))))"
    count = f"(length({value}) - length(replace({value}, c, '')))"
    return (
        f"aggregate(transform({chars}, c -> {count} / length({value})), cast(0 AS double), "
        f"(e, share) -> e - share * log2(share))"
    )


def _spans(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`row`, the columns `keep` and the candidates of `text`, with the hash of their value in
    place of the value."""
    kinds = [F.expr(_found(k, p, cond)) for k, (_, p, cond) in enumerate((*BASE, *ADDED))]
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(*keep, F.array_sort(F.concat(*kinds)).alias("found"))
    secret = f"CASE WHEN s.kind = 0 THEN regexp_extract(s.value, {literal(ASSIGN)}, 2) ELSE s.value END"
    live = f"({entropy('x')} >= {MIN_ENTROPY} AND NOT x RLIKE '{PLACEHOLDER}')"
    spans = F.expr(
        "transform(found, s -> element_at(transform(array(" + secret + "), x -> struct("
        f"s.start AS start, s.kind AS kind, s.`end` AS `end`, sha2(x, 256) AS hash, {live} AS live)), 1))")
    return rows.select(F.monotonically_increasing_id().alias("row"), *keep, spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories over all candidates: reduced per (hash, owner,
    repository), then per (hash, owner), so that no hash of a popular example is gathered."""
    each = found.select("owner", "repository", F.explode("spans.hash").alias("hash"))
    once = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("_one"))
    owners = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _reported(found: DataFrame, min_owners: int, min_repositories: int) -> DataFrame:
    """row and its reported spans, for rows of the written table that have any."""
    copied = (F.col("n_owners") >= min_owners) & (F.col("n_repositories") >= min_repositories)
    counts = ownership(found).select("hash", copied.alias("copied"))
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    each = each.join(by_shuffle(counts), "hash")
    verdict = F.when(F.col("copied"), "example").when(F.col("live"), "live").otherwise("weak")
    names = F.array(*[F.lit(k) for k in KINDS])
    each = each.withColumn("verdict", verdict).where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    # all spans of one document: bounded by its text
    item = F.struct("start", "kind", "end", F.get(names, F.col("kind")).alias("name"), "verdict")
    return each.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("reported"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repository_col: str = "doc_id", min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES,
) -> DataFrame:
    """doc_id and the reported spans (start, kind, end, verdict) of every row. Base kinds are
    always reported, with verdict `example`, `live` or `weak`; added kinds only as `live`."""
    rows = take_columns(docs, doc_id=id_col, owner=owner_col, repository=repository_col, text=text_col)
    found = stage(_spans(rows, ["doc_id", "owner", "repository"]), "candidates")
    per_row = _reported(found, min_owners, min_repositories)
    empty = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,name:string,verdict:string>>)")
    return found.select("row", "doc_id").join(by_shuffle(per_row), "row", "left").select(
        "doc_id", F.coalesce("reported", empty).alias("reported"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, by start, then kind as listed, joined by commas."""
    return F.expr(
        f"array_join(transform({spans}, s -> concat(s.name, ':', s.start, ':', s.`end`)), ',')")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans and all spans."""
    base = f"filter(reported, s -> s.kind < {len(BASE)})"
    counts = [
        F.expr(f"cast(size(filter(reported, s -> s.kind = {k})) AS bigint)").alias(f"n_{kind}")
        for k, (kind, _, _) in enumerate(BASE)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed("reported").alias("spans"),
        F.expr("cast(size(filter(reported, s -> s.verdict = 'live')) AS bigint)").alias("n_live"),
        F.expr("cast(size(filter(reported, s -> s.verdict = 'example')) AS bigint)").alias("n_example"))


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repository_col: str = "doc_id", chars_col: str | None = None, mark: str = "[secret]",
) -> DataFrame:
    """`docs` with every reported span replaced by `mark`, all other columns as they are.
    Only rows with candidates are shuffled; overlapping spans become one mark."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    flat = rows.select(
        "doc", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{owner_col}`").alias("owner"),
        F.col(f"doc.`{repository_col}`").alias("repository"), F.col(f"doc.`{text_col}`").alias("text"))
    spans = _spans(flat, ["doc", "doc_id", "owner", "repository"])
    found = stage(spans, "documents")
    reported = _reported(found, MIN_OWNERS, MIN_REPOSITORIES)
    text = f"doc.`{text_col}`"
    masked = F.expr(f"""aggregate(reported, struct(0 AS pos, '' AS done),
      (a, s) -> CASE WHEN s.start < a.pos THEN struct(greatest(a.pos, s.`end`) AS pos, a.done AS done)
        ELSE struct(s.`end` AS pos, concat(a.done, substring({text}, a.pos + 1, s.start - a.pos), {literal(mark)}) AS done) END,
      a -> concat(a.done, substring({text}, a.pos + 1)))""")
    some = found.where("size(spans) > 0").join(by_shuffle(reported), "row", "left")
    some = some.select("doc", F.when(F.col("reported").isNotNull(), masked).otherwise(F.col(text)).alias("_text"))
    none = found.where("size(spans) = 0").select("doc", F.col(text).alias("_text"))
    both = some.union(none)
    new = {text_col: F.col("_text")}
    if chars_col:
        new[chars_col] = F.length("_text").cast(docs.schema[chars_col].dataType)
    return both.select(*[
        (F.when(F.col(text).isNull(), F.col(f"doc.`{c}`")).otherwise(new[c]) if c in new
         else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
