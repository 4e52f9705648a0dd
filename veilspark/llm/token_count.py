"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a byte trie. Each node has a failure link to the node that remains when the
longest pieces of its path are taken off, and the number of pieces so taken off. One walk over
a word's bytes then adds up piece counts; it never goes back and builds no piece.

A word is what ASCII spaces separate, spelled with a space before it, as the pieces that begin
words are. Greedy means: always the longest piece of the vocabulary that comes next; bytes
that begin no piece count as one piece each.

Cases. Null or empty text: 0 words, 0 pieces. Repeated rows count alike. Empty table: empty
result.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_batches, take_columns, texts

REMEMBERED = 150_000  # words whose length a worker remembers
ROOT, NONE = 0, -1


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: Iterable[bytes]):
        next_, final = {}, [False]
        children: list[list[tuple[int, int]]] = [[]]
        for piece in pieces:
            node = ROOT
            for byte in piece:
                key = node << 8 | byte
                to = next_.get(key)
                if to is None:
                    to = next_[key] = len(final)
                    final.append(False)
                    children.append([])
                    children[node].append((byte, to))
                node = to
            final[node] = final[node] or bool(piece)
        for byte in range(256):  # every byte can be taken off
            if byte not in next_:
                next_[byte] = len(final)
                final.append(True)
                children.append([])
                children[ROOT].append((byte, next_[byte]))
            final[next_[byte]] = True
        self.next = next_
        self.fail, self.popped = [NONE] * len(final), [0] * len(final)
        level = [ROOT]
        while level:  # by depth: a link needs those of shorter paths
            below = []
            for node in level:
                for byte, to in children[node]:
                    below.append(to)
                    if final[to]:
                        self.fail[to], self.popped[to] = ROOT, 1
                        continue
                    at, popped = self.fail[node], self.popped[node]
                    while at != NONE and (at << 8 | byte) not in next_:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at != NONE:
                        self.fail[to], self.popped[to] = next_[at << 8 | byte], popped
            level = below

    def length(self, word: bytes) -> int:
        """Number of greedy pieces of a word."""
        next_, fail, popped = self.next, self.fail, self.popped
        node, total = ROOT, 0
        for byte in word:
            to = next_.get(node << 8 | byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                to = next_.get(node << 8 | byte)
            node = to
        while node != ROOT:
            total += popped[node]
            node = fail[node]
        return total


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece and rank per line)."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    automaton = Automaton(read_ranks(path))
    return functools.lru_cache(maxsize=REMEMBERED)(lambda word: automaton.length(b" " + word))


def count_tokens(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_pieces of every row. `vocabulary_path` is a rank file that every
    executor has, as part of an installed package. One narrow pass."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, n_words, n_pieces = _counter(vocabulary_path), [], []
        for text in texts(batch):
            words = Counter(text.encode().split())
            n_words.append(sum(words.values()))
            n_pieces.append(sum(n * length(w) for w, n in words.items()))
        return pa.record_batch(
            [column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())],
            ["doc_id", "n_words", "n_pieces"])

    return map_batches(
        rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_pieces bigint")
