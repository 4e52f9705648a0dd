"""The registered queries against plain Python on the smallest tables, whole texts and rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import mixture, queries, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "", r.source) for r in rows]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def result(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    return {r.doc_id: r for r in rows}


def test_near_duplicates(spark, sf_dir, documents):
    sets = {}
    for i, text, _ in documents:
        words = WORD.findall(lower(text))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = result(spark, sf_dir, "op1_circulant_minhash")
    for i in ids:
        r = got[i]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), find(i), find(i) == i)
    assert any(not r.kept for r in got.values())


def test_licences(spark, sf_dir, documents):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    got = result(spark, sf_dir, "op2_license_scan")
    some = 0
    for i, text, _ in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [
            (k, label) for label, p in phrases.items() for k in range(len(words))
            if words[k:k + len(p.split())] == p.split()]
        r = got[i]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base))
        assert base <= set(r.labels.split(",")) if base else True
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        some += bool(places)
    assert some


def test_mixture(spark, sf_dir, documents):
    rows = queries.QUERIES["op3_temperature_mixing"](spark, sf_dir).collect()
    tokens, uses = Counter(), Counter()
    for _, text, source in documents:
        tokens[source] += len(WORD.findall(text))
    for r in rows:
        uses[r.source] += r.n_tokens
    assert {r.doc_id for r in rows} == {i for i, _, _ in documents}
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}

    def weights(a):
        mass = {s: x**a for s, x in p.items()}
        return {s: m / sum(mass.values()) for s, m in mass.items()}

    def entropy(a):
        return -sum(q * math.log(q) for q in weights(a).values())

    top = max(p.values())
    ok = [
        a for a in np.linspace(0, 1, 20_001)
        if max((top / x) ** (1 - a) for x in p.values()) <= mixture.MAX_REPEATS
        and (a == 1 or entropy(a) <= mixture.ENTROPY * math.log(len(p)))]
    want = weights(ok[0])
    for r in rows:
        assert r.weight == pytest.approx(want[r.source], rel=2e-3)
        assert 0 <= r.place <= 1
    scale = max(tokens[s] / want[s] for s in p)
    largest = max(len(WORD.findall(t)) for _, t, _ in documents)
    for s in p:  # budgets are met up to one block
        assert uses[s] <= want[s] * scale + 1
        assert uses[s] >= want[s] * scale * 0.98 - largest


def test_mixing_skewed_sources(spark):
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "repeat('w ', 10) AS text",
        "CASE WHEN id % 10 < 7 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE null END AS source")
    rows = mixture.mix(docs, max_repeats=3.0, entropy=1.0).groupBy("source").sum("n_tokens").collect()
    used = {r[0]: r[1] for r in rows}
    # shares .7 .2 .1; the smallest source may come 3 times: (.7/.1)^(1-a) = 3
    a = 1 - math.log(3) / math.log(7)
    want = {"a": 28_000, "b": 8000 * (0.7 / 0.2) ** (1 - a), None: 12_000}
    for s, n in want.items():
        assert used[s] == pytest.approx(n, rel=0.01)
    order = [r.source for r in mixture.mixed_documents(docs, max_repeats=3.0, entropy=1.0).collect()]
    half = Counter(order[: len(order) // 2])
    whole = Counter(order)
    assert all(half[s] == pytest.approx(whole[s] / 2, rel=0.1) for s in whole)


def test_bpe(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.vocabulary(queries.BPE_FILE))
    got = result(spark, sf_dir, "op4_bpe_round_trip")
    for i, text, _ in documents:
        ids = tool.encode(text, add_special_tokens=False).ids
        back = tool.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_secrets(spark, documents):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = result(spark, folder, "op5_secret_ownership")
    names, some = ("assign", "access", "hex"), Counter()
    for i, text in rows:
        spans = base_spans(text or "")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r.spans.split(","))
        some.update(names[k] for _, k, _ in spans)
    assert set(some) == {"assign", "hex"}


def test_token_counts(spark, sf_dir, documents):
    pieces = set(token_count.read_ranks(queries.vocabulary(queries.RANKS_FILE)))
    longest = max(map(len, pieces))

    def greedy(word):
        at = n = 0
        while at < len(word):
            size = min(longest, len(word) - at)
            while size > 1 and word[at:at + size] not in pieces:
                size -= 1
            at, n = at + size, n + 1
        return n

    got, known = result(spark, sf_dir, "op6_greedy_token_count"), {}
    for i, text, _ in documents:
        words = text.encode().split()
        total = sum(known.setdefault(w, greedy(b" " + w)) for w in words)
        assert (got[i].n_words, got[i].n_pieces) == (len(words), total)


def test_line_rule_counts(spark, sf_dir, documents):
    got = result(spark, sf_dir, "op7_line_rules")
    kept = 0
    for i, text, _ in documents:
        words = WORD.findall(text)
        windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        counts = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_dup_lines, r.n_repeat_words) == (dup, len(repeated))
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)
        kept += r.kept
    assert kept > len(documents) / 2


def ranked(labels, scores):
    """Area under the curve."""
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name, label, parts, held, least", [
    ("op8_quality_machine", "quality", 5, 0, 0.95), ("op9_subword_toxicity", "toxic", 3, 1, 0.9)])
def test_classifiers(spark, name, label, parts, held, least):
    folder = "/root/testdata/sf0.1"
    labels = {
        r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = result(spark, folder, name)
    assert len(got) == 10_000
    for i, r in list(got.items())[:500]:
        assert r.held_out == (zlib.crc32(str(i).encode()) % parts == held)
        assert r.predicted == (r.score >= {"quality": 0.3, "toxic": 0.7}[label])
    test = [i for i in labels if got[i].held_out]
    assert ranked([labels[i] for i in test], [got[i].score for i in test]) >= least


PARAGRAPH = re.compile(r"[^\n]{1,128}[^\n.!?]*[.!?]*")


def test_fingerprints(spark, sf_dir, documents):
    got = result(spark, sf_dir, "op10_lookup_sketch")
    by_print = defaultdict(set)
    for n, (i, text, _) in enumerate(documents):
        after = documents[(n + 1) % len(documents)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, x = (set(PARAGRAPH.findall(t)) for t in (text, edited, after))
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)
        assert r.near_next == pytest.approx(len(a & x) / len(a | x) if a | x else 1.0)
        by_print[r.fingerprint].add(frozenset(a))
    assert all(len(v) == 1 for v in by_print.values())
