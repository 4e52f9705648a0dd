"""Which values of a file occur in which of its texts: an index of heads.

The head of a value is its first window of `WINDOW` consecutive grams, `SPAN` code points. It
stands wherever the value stands, so an equi-join of the texts' windows with the values' heads
finds every place where a value can be, and cutting the text there decides. A head is long enough
that a file of millions of numbers has few values of one head but of many lengths; a single gram
is not: there are 100,000 of five digits, and soon a value behind each. Shorter values are looked
up as they are, length by length.

Before anything is sent, a bit table of the heads (at most `MOST_BITS` bits, whatever the
number of values) drops the windows that no value of the file begins with: what is shuffled grows
with the places where values may be, not with the characters of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .skew import counted_join, written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1  # shortest value that has an anchor
PIECE = 1 << 20  # code points of a text that are hashed at once
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
BITS_PER_ANCHOR = 64
HELD = 50_000  # rows that a task holds before it passes them on
MANY_HEADS = 200  # from so many on, a text is walked through once instead of once for each
BITMAP = 32_768  # bits of one row of Spark's bitmaps

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive code points."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + codes[k : k + len(out)]
    out = (out ^ (out >> np.uint64(30))) * _MIX
    return out ^ (out >> np.uint64(27))


def _least(hashes: np.ndarray) -> np.ndarray:
    """For each window of consecutive grams, the place of the least one, the first of equal ones."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.arange(len(windows)) + windows.argmin(axis=1)


def _salt(file_id: str) -> int:
    return zlib.crc32(file_id.encode())


def _bit(hashes: np.ndarray, kind: int, salts: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a gram of a file; `salts` holds one number per gram."""
    mixed = (hashes ^ ((salts + np.uint64(kind)) * _FACTOR)) * _MIX
    return (mixed ^ (mixed >> np.uint64(31))) & np.uint64(bits - 1)


def minimisers(text: str) -> list[tuple[int, str]]:
    """(place, gram) of the minimisers of a text."""
    return [(int(p), text[p : p + GRAM]) for p in np.unique(_least(_hashes(_codes(text), GRAM)))]


def _columns(batch: pa.RecordBatch, names: list[str], rows: list[int]) -> list[pa.Array]:
    at = pa.array(rows, pa.int64())
    return [batch.column(batch.schema.get_field_index(n)).take(at) for n in names]


def _schema(df: DataFrame, names: list[str], more: str) -> StructType:
    out = StructType([df.schema[n] for n in names])
    for f in StructType.fromDDL(more):
        out = out.add(f)
    return out


# -- values -------------------------------------------------------------------------

def anchors(values: DataFrame, file: str, bits: int = LEAST_BITS) -> DataFrame:
    """(file, value, kind, head, bit): kind 0 with its first `SPAN` code points for a value of at
    least so many, else the value itself with its length as kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            file_ids = batch.column(batch.schema.get_field_index("_file"))
            texts = batch.column(batch.schema.get_field_index("value"))
            for i, (file_id, value) in enumerate(zip(file_ids.to_pylist(), texts.to_pylist())):
                if not value or file_id is None:
                    continue
                head = value[:SPAN]
                kind = 0 if len(head) == SPAN else len(head)
                salt = np.array([_salt(file_id)], np.uint64)
                bit = _bit(_hashes(_codes(head), len(head)), kind, salt, bits)[0]
                rows.append(i)
                out.append((kind, head, int(bit)))
            if rows:
                kinds, heads, bit = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    *_columns(batch, [file, "value"], rows), pa.array(kinds, pa.int32()),
                    pa.array(heads, pa.string()), pa.array(bit, pa.int64()),
                ], [file, "value", "kind", "head", "bit"])

    given = values.select(file, "value", F.col(file).cast("string").alias("_file"))
    schema = _schema(given, [file, "value"], "kind int, head string, bit bigint")
    return given.mapInArrow(run, schema)


def bit_table(anchored: DataFrame, bits: int) -> np.ndarray:
    """The bits of all anchors; at most MOST_BITS / 8 bytes reach the driver."""
    # dealt out first: a bitmap for each part and task would be larger than the bits
    parts = anchored.select("bit", F.expr(f"bit div {BITMAP}").alias("part")).repartition("part")
    maps = parts.groupBy("part").agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits")).collect()
    out, size = np.zeros(bits // 8, np.uint8), BITMAP // 8
    for r in maps:
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


# -- texts --------------------------------------------------------------------------

def grams(
    texts: DataFrame, keys: list[str], file: str, text: str, kinds: list[int], table: np.ndarray,
    bits: int,
) -> DataFrame:
    """(keys, kind, gram, head): what a text shares, by its bits, with the heads of the values of its
    file, once; `gram` is the minimiser of the head, for a short value (kind > 0) the value."""

    def shared(parts: list[tuple[int, str, int]]) -> set[tuple[int, int, str, str]]:
        """(row, kind, gram, head) of stretches (row, text, salt), all of them hashed at once."""
        joined = "".join(p[1] for p in parts)
        codes, sizes = _codes(joined), [len(p[1]) for p in parts]
        part = np.repeat(np.arange(len(parts)), sizes)
        left = np.cumsum(sizes)[part] - np.arange(len(codes))  # code points up to the stretch's end
        salts = np.array([p[2] for p in parts], np.uint64)
        out = set()
        for kind in kinds:
            n = kind or SPAN
            hashes = _hashes(codes, n)
            places = np.flatnonzero(left[: len(hashes)] >= n)
            bit = _bit(hashes[places], kind, salts[part[places]], bits)
            on = table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            places = places[on == 1]
            grams_at = places if kind else _least(_hashes(codes, GRAM))[places]
            out.update((parts[row][0], kind, joined[g : g + (kind or GRAM)], joined[p : p + n]) for row, p, g in zip(
                part[places].tolist(), places.tolist(), grams_at.tolist()))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file_ids = batch.column(batch.schema.get_field_index("_file"))
            contents = batch.column(batch.schema.get_field_index("_text"))
            parts, held = [], 0
            for i, (file_id, content) in enumerate(zip(file_ids, contents)):
                if not content.is_valid or not file_id.is_valid:
                    continue
                content, salt = content.as_py(), _salt(file_id.as_py())
                for at in range(0, len(content), PIECE):
                    parts.append((i, content[at : at + PIECE + SPAN - 1], salt))  # overlapping by one window
                    held += len(parts[-1][1])
                    if held >= PIECE:
                        yield from rows_of(batch, shared(parts))
                        parts, held = [], 0
            yield from rows_of(batch, shared(parts))

    def rows_of(batch: pa.RecordBatch, found: set[tuple[int, int, str, str]]) -> Iterator[pa.RecordBatch]:
        if found:
            rows, kind_of, gram_of, head_of = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*_columns(batch, keys, rows), pa.array(kind_of, pa.int32()), pa.array(gram_of, pa.string()),
                 pa.array(head_of, pa.string())], [*keys, "kind", "gram", "head"])

    given = texts.select(*keys, F.col(file).cast("string").alias("_file"), F.col(text).alias("_text"))
    return given.mapInArrow(run, _schema(given, keys, "kind int, gram string, head string")).distinct()


def _stretches(content: str, tried: list[dict]) -> Iterator[str]:
    """The stretches of a text that begin with a head and are as long as one of its values."""
    lengths = {t["head"]: t["lengths"] for t in tried}
    if len(lengths) < MANY_HEADS:
        for head in lengths:
            p = content.find(head)
            while p >= 0:
                yield from (content[p : p + n] for n in lengths[head] if p + n <= len(content))
                p = content.find(head, p + 1)
    else:
        for p in range(len(content) - SPAN + 1):
            yield from (content[p : p + n] for n in lengths.get(content[p : p + SPAN], ()) if p + n <= len(content))


def _cut(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the stretches of a text that may be values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pieces = [], []
            contents = batch.column(batch.schema.get_field_index("_text"))
            tried = batch.column(batch.schema.get_field_index("_tried"))
            for i, (content, heads) in enumerate(zip(contents, tried)):
                found = set()
                for piece in _stretches(content.as_py(), heads.as_py()):
                    if piece not in found:
                        found.add(piece)
                        at.append(i)
                        pieces.append(piece)
                    if len(at) >= HELD:
                        yield rows_of(batch, at, pieces)
                        at, pieces, found = [], [], set()
            if at:
                yield rows_of(batch, at, pieces)

    def rows_of(batch: pa.RecordBatch, at: list[int], pieces: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*_columns(batch, keys, at), pa.array(pieces, pa.string())], [*keys, "value"])

    return rows.mapInArrow(run, _schema(rows, keys, "value string"))


def find_values(
    texts: DataFrame, values: DataFrame, keys: list[str], file: str = "file_id",
    text: str = "text", cols: list[str] | None = None,
) -> DataFrame:
    """(file, keys, value) and `cols` of `values`, for every value of the file that occurs anywhere
    in the text, once. `values` has one row per (file, value) and is best a written table; `keys`
    identify a text (rows that share them share their text). Texts or values with a null key are
    not looked at. Exact: the index proposes, an equi-join with the values decides."""
    all_keys = list(dict.fromkeys([file, *keys]))
    cols = cols or []
    sizes = values.where(F.col(file).isNotNull()).groupBy(
        F.when(F.length("value") >= SPAN, 0).otherwise(F.length("value")).alias("kind")
    ).count().collect()  # at most SPAN rows
    kinds = sorted(r["kind"] for r in sizes if r["kind"] is not None)
    wanted = BITS_PER_ANCHOR * sum(r["count"] for r in sizes)
    bits = LEAST_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    anchored = written(anchors(values, file, bits), "anchors")
    named = texts.dropna(subset=all_keys).select(*all_keys, F.col(text).alias("_text"))
    sent = written(grams(named, all_keys, file, "_text", kinds, bit_table(anchored, bits), bits), "grams")

    index = anchored.where("kind = 0").groupBy(file, "head").agg(
        F.collect_set(F.length("value")).alias("lengths"))
    hits = counted_join(sent.where("kind = 0").drop("kind", "gram"), index, [file, "head"], ["lengths"])
    per_text = hits.groupBy(*all_keys).agg(F.collect_list(F.struct("head", "lengths")).alias("_tried"))
    pieces = _cut(named.join(per_text, all_keys), all_keys).distinct()
    short = sent.where("kind > 0").select(*all_keys, F.col("head").alias("value"))
    known = values.select(file, "value", *cols)
    return counted_join(written(pieces.unionByName(short), "pieces"), known, [file, "value"], cols)
