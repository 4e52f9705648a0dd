"""Near-duplicate documents by circulant MinHash.

Each document is the set of its distinct 5-word shingles. Two permutations make the whole
signature: the first puts a shingle at a place of a fixed table, the second is the table's
content, and coordinate k reads it shifted by k places. All coordinates of a shingle are thus
one slice of the table, and a signature is the minimum over such slices.

Steps, all as joins and groupings:
1. one row per distinct set, numbered, with its bands and a one-byte sketch of its signature;
   links and components are among these numbers, not among ids, which several sets may share;
2. star round: in each band bucket every set is a candidate only of the bucket's smallest number,
   so a bucket of a million copies gives a million candidates, not all pairs;
3. candidates are confirmed on the full sets, and confirmed links give components;
4. rest round: buckets that still hold several components are compared across components in
   blocks, so that no link is lost when two members are like each other but not like the
   smallest one. Pairs are confirmed in the task that finds them and leave it only as links.

Cases. Null or empty text, or no word: empty set, linked with nothing. Fewer than five words:
the whole sequence is one shingle. Rows that repeat an id count as one document per distinct
set. Rows without an id are linked like others and the last choice of their group; as there is
no id to name, `near_duplicates` reports them without a component and as kept, and
`keep_one_of_each` drops them by their text. Empty table: empty result. Bands find a pair of
similarity s with 1-(1-s^4)^32: all but 5 in a million at 0.75, more above.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, by_shuffle, column, map_arrow, map_batches, stage, take_columns, texts

SHINGLE = 5
PERCENT = 75  # of the union that two sets must share
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20  # places of the second permutation
SEED = 20_011
# Sketches of two sets of similarity 0.75 agree in fewer coordinates with a chance below 1e-6.
AGREE = 72
BLOCK = 512  # members of a bucket per block in the rest round
SALT = 512  # members confirmed against one copy of their hub's text

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _slices() -> np.ndarray:
    """Row p is the second permutation at p, p+1, … for all coordinates (a view, no copy)."""
    table = np.random.RandomState(SEED).permutation(UNIVERSE).astype(np.uint32)
    table = np.concatenate([table, table[:COORDINATES]])
    return np.lib.stride_tricks.sliding_window_view(table, COORDINATES)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of the lower-cased (A-Z) text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        whole = b"\0".join(words) + b"\0" + str(len(words)).encode()
        return np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = ids[:n].copy()
    for k in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * _ODD + ids[k : k + n]
    out = (out ^ (out >> np.uint64(30))) * _MIX
    return np.unique(out ^ (out >> np.uint64(27)))


def signature(items: np.ndarray) -> np.ndarray:
    """All signature coordinates of a non-empty set of 64-bit shingle hashes."""
    slices = _slices()
    places = ((items * _ODD) >> np.uint64(44)).astype(np.int64)  # first permutation
    out = np.full(COORDINATES, UNIVERSE, np.uint32)
    for at in range(0, len(places), 4096):
        np.minimum(out, slices[places[at : at + 4096]].min(axis=0), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, different for each band."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * _ODD + rows[:, r]
    key = (key ^ (key >> np.uint64(30))) * _MIX
    return (key ^ (key >> np.uint64(27))).view(np.int64)


def _digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, digests, sketches, bands = [], [], [], []
    for text in texts(batch):
        items = shingles(text)
        sizes.append(len(items))
        if len(items):
            coordinates = signature(items)
            digests.append(_digest(items))
            sketches.append((coordinates & 0xFF).astype(np.uint8).tobytes())
            bands.append(band_keys(coordinates))
        else:
            digests.append(None)
            sketches.append(None)
            bands.append(None)
    return pa.record_batch(
        [column(batch, "doc_id"), column(batch, "text_key"), pa.array(sizes, pa.int64()),
         pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()),
         pa.array(bands, pa.list_(pa.int64()))],
        ["doc_id", "text_key", "n_shingles", "digest", "sketch", "bands"],
    )


def text_key(text: Column) -> Column:
    """With the id, this finds a row again."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, text_key."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set, sketch and band keys (null for empty sets)."""
    return map_batches(
        keyed_rows(docs, id_col, text_col), _sets,
        "doc_id bigint, text_key binary, n_shingles bigint, digest binary, sketch binary, bands array<bigint>")


def _with_texts(wanted: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """`wanted` (by `rep`) with the text of a row that has the set."""
    places = reps.select("rep", "doc_id", "text_key")
    wanted = wanted.join(by_shuffle(places), "rep")
    found = rows.join(by_shuffle(wanted), ["doc_id", "text_key"])
    if not places.where("doc_id IS NULL").isEmpty():
        # any number of rows without an id may have one text
        once = rows.where("doc_id IS NULL").dropDuplicates(["text_key"]).drop("doc_id")
        found = found.unionByName(once.join(by_shuffle(wanted.where("doc_id IS NULL")), "text_key"))
    return found.drop("doc_id", "text_key")


def _stars(members: DataFrame) -> DataFrame:
    """(hub, rep): in each bucket every set with the bucket's smallest number."""
    hubs = members.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("_last"))
    hubs = hubs.where("hub < _last").select("band", "hub")
    pairs = members.join(by_shuffle(hubs), "band").where("hub < rep")
    return pairs.select("hub", "rep").distinct()


def _candidates(rows: dict[str, np.ndarray], band: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of one cell: a row and the rows it may be linked to, that is rows of another
    component whose sketch agrees. Of the buckets that two sets share, only that of their first
    common band names them."""
    side, rep, component = rows["side"], rows["rep"], rows["component"]
    sketch, bands = rows["sketch"], rows["bands"]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inside = not len(right)
    right = left if inside else right
    for i in left:
        near = component[right] != component[i]
        if inside:
            near &= rep[right] > rep[i]
        to = right[near]
        to = to[(sketch[to] == sketch[i]).sum(axis=1) >= AGREE]
        if len(to):
            first = (bands[to] == bands[i]).argmax(axis=1)
            to = to[bands[i][first] == band]
        if len(to):
            yield i, to


def _members(group: list[pa.RecordBatch]) -> tuple[pa.Table, dict[str, np.ndarray], int]:
    table = pa.Table.from_batches(group)
    rows = {n: table.column(n).to_numpy() for n in ("side", "rep", "component")}
    sketch = b"".join(table.column("sketch").to_pylist())
    rows["sketch"] = np.frombuffer(sketch, np.uint8).reshape(-1, COORDINATES)
    bands = pa.concat_arrays(table.column("bands").chunks).flatten().to_numpy()
    rows["bands"] = bands.reshape(-1, BANDS)
    return table, rows, table.column("band")[0].as_py()


def _wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a candidate there."""
    for group in runs(batches, ["band", "cell"]):
        table, rows, band = _members(group)
        wanted = np.zeros(len(table), bool)
        for i, to in _candidates(rows, band):
            wanted[i] = True
            wanted[to] = True
        if wanted.any():
            yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell whose full sets are similar enough."""
    for group in runs(batches, ["band", "cell"]):
        table, rows, band = _members(group)
        sets = [shingles(t.as_py() or "") for t in table.column("text")]
        digests = table.column("digest").to_pylist()
        valid = np.array([len(s) and _digest(s) == d for s, d in zip(sets, digests)], bool)
        found: set[tuple[int, int]] = set()
        for i, to in _candidates(rows, band):
            if not valid[i]:
                continue
            own = sets[i]
            for j in to[valid[to]].tolist():
                other = sets[j]
                at = np.searchsorted(own, other)
                at[at == len(own)] = 0
                common = int((own[at] == other).sum())
                if 100 * common >= PERCENT * (len(own) + len(other) - common):
                    pair = int(rows["rep"][i]), int(rows["rep"][j])
                    found.add((min(pair), max(pair)))
        if found:
            a, b = zip(*found)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["hub", "rep"])


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Cut sorted batches into groups of equal keys; one group is held at a time."""
    group, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for at, to in zip(starts, starts[1:]):
            key = tuple(c[at] for c in cols)
            if group and key != last:
                yield group
                group = []
            group.append(batch.slice(at, to - at))
            last = key
    if group:
        yield group


def _rest(reps: DataFrame, components: DataFrame, rows: DataFrame) -> DataFrame:
    """Confirmed links (hub, rep) across the components that still share a bucket.

    Buckets are cut into blocks, and each pair of blocks is a cell of bounded size. A first
    pass finds the members with candidates; only they get their text, once per cell, and a
    second pass confirms on full sets. No pair leaves a task before it is confirmed.
    """
    placed = reps.join(by_shuffle(components), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component"), F.explode("bands").alias("band"))
    mixed = placed.groupBy("band").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("n"))
    mixed = mixed.where("_a < _b").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(by_shuffle(mixed), "band").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # each member meets its own block (cell b,b) and every other one (cell i,j with i < j)
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = cells.select(
        "band", (low.cast("bigint") * F.col("blocks") + high).alias("cell"), "rep", "component",
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    cells = cells.join(by_shuffle(reps.select("rep", "digest", "sketch", "bands")), "rep")
    cells = cells.repartition("band", "cell").sortWithinPartitions("band", "cell")
    wanted = stage(map_arrow(cells, _wanted, cells.schema), "wanted")
    full = _with_texts(wanted, reps, rows)
    full = full.repartition("band", "cell").sortWithinPartitions("band", "cell")
    return map_arrow(full, _linked, "hub bigint, rep bigint").distinct()


def _confirm_run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, rep): the hub's own text comes first in its run."""
    hub_key, hub_items = None, None
    for batch in rows:
        found_a, found_b = [], []
        for hub, salt, rep, digest, text in zip(
            column(batch, "hub").to_pylist(), column(batch, "salt").to_pylist(),
            column(batch, "rep").to_pylist(), column(batch, "digest").to_pylist(), texts(batch),
        ):
            if rep == hub and hub_key == (hub, salt) and hub_items is not None:
                continue  # the id occurs on several rows with this text
            items = shingles(text)
            if not len(items) or _digest(items) != digest:
                continue  # another text with the same key
            if rep == hub:
                hub_key, hub_items = (hub, salt), items
            elif hub_key == (hub, salt):
                common = len(np.intersect1d(hub_items, items, assume_unique=True))
                if 100 * common >= PERCENT * (len(hub_items) + len(items) - common):
                    found_a.append(hub)
                    found_b.append(rep)
        if found_a:
            yield pa.record_batch(
                [pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["hub", "rep"])


def _agreeing(batch: pa.RecordBatch) -> pa.RecordBatch:
    left = np.frombuffer(b"".join(column(batch, "hub_sketch").to_pylist()), np.uint8)
    right = np.frombuffer(b"".join(column(batch, "rep_sketch").to_pylist()), np.uint8)
    same = (left == right).reshape(-1, COORDINATES).sum(axis=1) >= AGREE
    return batch.select(["hub", "rep"]).filter(pa.array(same))


def _confirm(pairs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (hub < rep) whose full sets are similar enough.

    A hub's text is sent once per `SALT` of its members, each member's text once per pair.
    """
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT).alias("_salts"))
    member = pairs.join(by_shuffle(salts), "hub").select(
        "rep", "hub", F.pmod(F.xxhash64("rep"), F.col("_salts")).alias("salt"))
    hub = salts.select(
        F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"))
    wanted = member.union(hub).join(by_shuffle(reps.select("rep", "digest")), "rep")
    found = _with_texts(wanted, reps, rows).select("hub", "salt", "rep", "digest", "text")
    found = found.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "rep")
    return map_arrow(found, _confirm_run, "hub bigint, rep bigint")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles and digest of every row, with the id and the digest of the
    document that its group keeps: the smallest id, then the smallest digest (both null for
    empty sets; the id is null where the whole group has none)."""
    rows = keyed_rows(docs, id_col, text_col)
    sets = stage(shingle_sets(docs, id_col, text_col), "sets")
    some = sets.where("digest IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("_at")
    some = some.groupBy("digest").agg(first, F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    reps = stage(
        some.select(
            F.monotonically_increasing_id().alias("rep"), "_at.doc_id", "_at.text_key", "digest", "sketch", "bands"),
        "reps")
    sketches = reps.select("rep", "sketch")
    members = reps.select("rep", F.explode("bands").alias("band"))

    stars = _stars(members)
    stars = stars.join(by_shuffle(sketches.toDF("hub", "hub_sketch")), "hub")
    stars = stars.join(by_shuffle(sketches.toDF("rep", "rep_sketch")), "rep")
    stars = stage(map_batches(stars, _agreeing, "hub bigint, rep bigint"), "stars")
    links = stage(_confirm(stars, reps, rows), "links")
    components = components_of(links, "components")

    more = stage(_rest(reps, components, rows), "links")
    if not more.isEmpty():
        components = components_of(links.union(more), "components")

    # the smallest number of a component is not among its `rep`
    roots = components.select(F.col("component").alias("rep"), "component").distinct()
    components = components.select("rep", "component").union(roots)
    linked = components.join(by_shuffle(reps.select("rep", "doc_id", "digest")), "rep")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("_keeper")
    keepers = linked.groupBy("component").agg(least)
    keepers = components.join(by_shuffle(keepers), "component").select("rep", "_keeper")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    placed = reps.select("rep", "doc_id", "digest").join(by_shuffle(keepers), "rep", "left")
    placed = placed.select("digest", F.coalesce("_keeper", own).alias("_keeper"))
    return sets.select("doc_id", "text_key", "n_shingles", "digest").join(by_shuffle(placed), "digest", "left").select(
        "doc_id", "text_key", "n_shingles", "digest",
        F.col("_keeper.doc_id").alias("keeper_id"), F.col("_keeper.digest").alias("keeper_digest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    component_id is the smallest id that links reach, kept says whether the row is that
    document. See the module's text for the method and for odd input.
    """
    kept = F.col("doc_id").isNull() | F.col("digest").isNull() | (
        (F.col("doc_id") == F.col("keeper_id")) & (F.col("digest") == F.col("keeper_digest")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("keeper_id", "doc_id"))
    return _judged(docs, id_col, text_col).select(
        "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near-duplicates, all columns as they are. Of the
    texts of an id that have no word one stays; without an id all of them."""
    kept = _judged(docs, id_col, text_col).where(
        "digest IS NULL OR (doc_id <=> keeper_id AND digest = keeper_digest)")
    kept = kept.groupBy("doc_id", "digest").agg(F.min("text_key").alias("_near_key"))
    kept = stage(kept.select(F.col("doc_id").alias("_near_id"), "_near_key", "digest"), "kept")
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({"_near_id": F.col(f"`{id_col}`").cast("bigint"), "_near_key": text_key(text)})
    named = keyed.where("_near_id IS NOT NULL").join(
        by_shuffle(kept.select("_near_id", "_near_key")), ["_near_id", "_near_key"], "left_semi")
    # equal rows of an id already are in one partition
    named = named.dropDuplicates(["_near_id", "_near_key"])
    unnamed, worded = keyed.where("_near_id IS NULL"), F.coalesce(text, F.lit("")).rlike(WORD)
    once = unnamed.where(worded).dropDuplicates(["_near_key"]).join(
        by_shuffle(kept.where("_near_id IS NULL AND digest IS NOT NULL").select("_near_key")), "_near_key", "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.select(columns).union(once.select(columns)).union(unnamed.where(~worded).select(columns))


def components_of(links: DataFrame, name: str) -> DataFrame:
    """rep, component: the smallest number reachable, for every other number in `links` (hub, rep).

    Alternating large-star and small-star steps; each halves path lengths, and each written
    table holds at most the number of links.
    """
    edges = stage(links.select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), name)
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(by_shuffle(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_shuffle(least), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "rep")
