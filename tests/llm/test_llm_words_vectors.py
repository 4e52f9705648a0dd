"""Spelling variants, exact top-k and hard negatives against plain Python, on given and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import negatives, queries, spelling, topk, vectors


# -- spelling -----------------------------------------------------------------------

def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    by_cut = {}
    for w in words:  # only words that share a deletion, or are one, can be one edit apart
        for cut in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_cut.setdefault(cut, []).append(w)
    near = {w: set() for w in words}
    for group in by_cut.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_spelling_variants(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.QUERIES["op11_trie_frontier"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs)
    assert any(r[1] for r in got)


def test_spelling_of_odd_words(spark):
    """Long words around the bound, runs of equal letters, chains of forms, shared beginnings."""
    rng = random.Random(3)
    long = "".join(rng.choices("abcde", k=300))
    odd = [long, long[:50] + "z" + long[51:], long[:50] + long[51:], long + "q",
           *("a" * k for k in (7, 8, 63, 64, 65, 66)), "b" + "a" * 63, "b" + "a" * 62, "a" * 63 + "c",
           "aaaaaab", "éaaaaaaa", "abababab", "babababa", "ababababa", "sein×÷eß", "sein×÷eßß"]
    rows = [(k, w, "x", "x") for k, w in enumerate(odd * 2)]
    rows += [(None, "Hello Worldly", "x", "x"), (5, None, "x", "x"), (6, "", "x", "x"), (None, None, "x", "x")]
    # a chain: 2, 20 and 200 times
    rows += [(900 + k, " ".join(["chainlink"] * 2 + ["chainlinks"] * 25 + ["chainlinkss"] * 300), "x", "x")
             for k in range(2)]
    rows += [(800 + k, " ".join(f"sharedbeginning{c}" for c in "abcdefghijklmnop"), "x", "x") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, node string")
    got = [tuple(r) for r in spelling.spelling_variants(docs).collect()]
    want = plain_variants([r[:2] for r in rows])
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a root beyond the form
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    short = docs.where("length(text) < 10").select(F.col("text").alias("body"), F.col("doc_id").alias("key"))
    got = {tuple(r) for r in spelling.spelling_variants(short, "key", "body").collect()}
    assert got == plain_variants([r[:2] for r in rows if r[1] is not None and len(r[1]) < 10])


def test_counting_in_parts(spark, monkeypatch):
    """Bounds on what a task holds do not change counts."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abc", k=7)) for _ in range(5000))
    docs = [(k, text[k:]) for k in range(5)]
    monkeypatch.setattr(spelling, "HELD", 800)
    monkeypatch.setattr(spelling, "WHOLE_TEXT", 1000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([str(d[0]) for d in docs]), pa.array([d[1] for d in docs])], ["doc_id", "text"])
    counts, parts = Counter(), 0
    for out in spelling._counter(7, 31)([batch]):
        parts += 1
        counts.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())))
    assert parts > 3 and {w: n for w, n in counts.items() if n >= 2} == plain_words(docs)


# -- vectors --------------------------------------------------------------------------

def whole(rows):
    out = []
    for r in rows:
        v = r[1]
        if r[0] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((r[0], np.floor(256 * np.array(v, np.float64)).astype(np.int64), *r[2:]))
    return out


def product(a, b):
    n = min(len(a), len(b))
    return int(np.dot(a[:n], b[:n]))


def plain_top(rows, k=5, every=50):
    out = []
    for i, q, _ in whole(rows):
        if i % every == 0:
            scores = sorted((-product(q, c), j) for j, c, _ in whole(rows) if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def plain_negatives(rows, every=100):
    out, rows = [], [r for r in whole(rows) if r[2] is not None]
    for i, q, label in rows:
        if i % every:
            continue
        scores = sorted((-product(q, c), j, m == label) for j, c, m in rows if j != i)
        for p, pid, _ in [s for s in scores if s[2]][:5]:
            lies = [s for s in scores if not s[2] and 30 * -p <= -100 * s[0] <= 90 * -p][:10]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(lies)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_rows():
    """Clusters, ties, equal vectors, other lengths, nulls, infinities, huge and repeated rows."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 8] + rng.normal(size=8) * 0.05 * (i % 3)],
             int(rng.integers(0, 4))) for i in range(900)]
    rows += [(3000 + i, [0.0] * 8, i % 2) for i in range(201)]
    rows += [(4000 + i, [1.5, 2.5], i % 3) for i in range(60)]
    return rows + [
        (5000, [], 1), (5050, None, 1), (5100, [1.0, None], 2), (5101, [float("nan")] * 8, 2),
        (None, [1.0] * 8, 1), (5150, [float("inf")] + [0.0] * 7, 3), (5200, [1e6] * 8, 1),
        (5201, [-1e6] * 8, 1), (5300, [1.0] * 8, None), (5400, [1.0] * 8, 77),
        (10000, [-1.0] + [0.0] * 7, 88), (10001, [1.0] + [0.0] * 7, 88)]


def frame(spark, rows):
    extra = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(extra, "vec_id bigint, embedding array<float>, label int, block string, cell int")


def test_top_k(spark, odd_rows):
    got = [tuple(r) for r in topk.top_k(frame(spark, odd_rows)).collect()]
    assert sorted(got) == plain_top(odd_rows)
    few = odd_rows[:3]
    assert sorted(map(tuple, topk.top_k(frame(spark, few)).collect())) == plain_top(few)
    assert topk.top_k(frame(spark, [])).collect() == []


def test_top_k_over_many_centres_and_blocks(spark, odd_rows, monkeypatch):
    """Small blocks, trees and groups, so that pairs of cells are passed over."""
    for name, value in {"ROWS_PER_CENTRE": 50, "TREE_ROWS": 16, "GROUP_ROWS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk, "block_rows", lambda n, dims: 40)
    got = [tuple(r) for r in topk.top_k(frame(spark, odd_rows)).collect()]
    assert sorted(got) == plain_top(odd_rows)


def test_too_long_vectors_take_no_part(spark, odd_rows):
    rows = odd_rows[:60]
    got = topk.top_k(frame(spark, [*rows, (5202, [1e30] * 8, 1)])).collect()
    assert sorted(map(tuple, got)) == plain_top(rows)


def test_cover_tree():
    """Every point is in the tree once, within the radius of each node above it; the children's
    centres are more than half their parent's radius apart."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-300, 300, (200, 6)), np.repeat(rng.integers(-9, 9, (4, 6)), 30, 0)])
    tree = topk.CoverTree(points)
    assert sorted(tree.order) == list(range(len(points)))
    todo = [tree.root]
    while todo:
        node = todo.pop()
        centres = tree.vectors[node.centres]
        reach = max(np.linalg.norm(tree.vectors[node.lo:node.hi] - tree.vectors[node.lo], axis=1))
        for kid, centre, radius in zip(node.kids, centres, node.radii):
            assert np.linalg.norm(tree.vectors[kid.lo:kid.hi] - centre, axis=1).max() <= radius + 1e-6
        if node.hi - node.lo > 1:
            assert [k.lo for k in node.kids][1:] == [k.hi for k in node.kids][:-1]
            gaps = np.linalg.norm(centres[:, None] - centres, axis=2)[np.triu_indices(len(centres), 1)]
            assert reach == 0 or gaps.size == 0 or gaps.min() > reach / 2 - 1e-6
            todo += [k for k in node.kids if k is not node]


def test_pruning_saves_products():
    """In clustered data most pairs of nodes are passed over."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(32, 16)) * 256
    points = np.floor(np.repeat(base, 32, 0) + rng.normal(size=(1024, 16)) * 2).astype(np.int64)
    tree = topk.CoverTree(points)
    search = topk.Search(points[::64], np.arange(-16, 0), np.full(16, -np.inf), 5)
    compared, plain = 0, topk.products

    def counted(a, b):
        nonlocal compared
        compared += len(a) * len(b)
        return plain(a, b)

    topk.products = counted
    try:
        search.add(tree, tree.order)
    finally:
        topk.products = plain
    assert compared < 16 * 1024 / 4
    want = [sorted((-int(q @ p), i) for i, p in enumerate(points))[:5] for q in points[::64][search.tree.order]]
    got = [[] for _ in want]
    for row, score, i in zip(search.rows, search.scores, search.found):
        got[row].append((-int(score), int(i)))
    assert [sorted(g) for g in got] == want


def test_products_are_exact():
    for top in (10, 1 << 20, 1 << 29):
        rng = np.random.default_rng(top)
        a, b = rng.integers(-top, top, (5, 6)), rng.integers(-top, top, (7, 6))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert vectors.products(a, b).tolist() == want


def test_hard_negatives(spark, odd_rows):
    got = [tuple(r) for r in negatives.mine(frame(spark, odd_rows)).collect()]
    assert sorted(got) == plain_negatives(odd_rows)
    assert negatives.mine(frame(spark, [])).collect() == []
    assert negatives.mine(frame(spark, [r for r in odd_rows if r[2] == 77])).collect() == []


def test_hard_negatives_over_many_blocks(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(negatives, "block_rows", lambda n, dims: 40)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 2)
    got = [tuple(r) for r in negatives.mine(frame(spark, odd_rows)).collect()]
    assert sorted(got) == plain_negatives(odd_rows)


def test_repeated_rows(spark):
    """A repeated row counts again for others, is not offered to its own id, and asks once."""
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2)]
    got = [tuple(r) for r in topk.top_k(frame(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 32768)]
    got = [tuple(r) for r in negatives.mine(frame(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 1, 2, 65536, 32768)]


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_cover_tree_top_k"](spark, sf_dir).collect()]
    assert sorted(got) == plain_top(rows)
    moved = [(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m in rows]
    got = [tuple(r) for r in queries.QUERIES["op13_window_negatives"](spark, sf_dir).collect()]
    assert sorted(got) == plain_negatives(moved)
