"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the last 16 code points cuts a text wherever its low bits are zero, so a
passage that several documents share is cut into the same chunks in all of them. A chunk met
before takes its ids from the worker's chunk cache (bounded, least recently used goes first;
workers keep it from task to task), so it is encoded once and no text is shuffled.

Chunks are encoded alone, so ids near a join can be wrong. The encoder first splits a text
into pre-tokens from left to right, and a split depends only on where it starts and on the few
characters it looks at. Each join is therefore repaired: from the last pre-token start of the
left side that its own end cannot have influenced, the text is encoded again into the right
chunk, further and further, until the new split meets a pre-token start of the right chunk.
From there on both agree exactly, and the right chunk's ids are taken over. A pre-token that goes on
over many chunks (one letter a million times) has no start to meet: then the stretch encoded again
doubles, so that the whole stays linear in the text.

A file whose normalizer, pre-tokenizer or decoder is another than this encoder's is left to the
library, text by text.

Cases. Null or empty text: no ids, empty decoded text. A chunk never ends within the text of
an added token, since such texts are cut out first. Long runs without a cut are chunks of at
most `MAX_CHUNK` characters. Repeated rows get equal ids. Empty table: empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections import OrderedDict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import column, map_batches, take_columns, texts

WINDOW = 16
MASK = 511  # a cut every 512 code points on average
MIN_CHUNK, MAX_CHUNK = 64, 8192
CACHED = 12_000_000  # code points of cached chunks per worker, about 60 MB
CACHED_WORDS = 300_000  # pre-tokens whose ids a worker remembers, about 60 MB
WORD_CHARS = 64  # longer pre-tokens are not remembered
# A pre-token's end is certain only if the text goes on by so many characters after its start:
# the longest contraction has three.
LOOKAHEAD = 3

# The tokenizer's rule for pre-tokens, written out for texts of ASCII and accented Latin
# letters. Chunks with any other character are split by the library itself, so its tables of
# Unicode classes always decide.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN = re.compile("[\n\x20-\x7e\u00c0-\u024f]*")
_WORDS = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+")

# How byte-level vocabularies spell bytes: those that print stand for themselves, the others
# follow from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_MULTIPLIER = np.uint32(2_654_435_761)


class Chunk(NamedTuple):
    ids: np.ndarray  # uint32
    starts: np.ndarray  # code point at which each pre-token starts
    firsts: np.ndarray  # index of each pre-token's first id


def _byte_level(spec: dict) -> bool:
    """Is a tokenizer file of the kind that this encoder spells out?"""
    before, after, model = (spec.get(k) or {} for k in ("pre_tokenizer", "decoder", "model"))
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return (
        spec.get("normalizer") is None and before.get("type") == after.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
        and model.get("type") == "BPE" and not any(model.get(k) for k in plain)
        and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    )


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text; the last one is its length."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    rolling = (points + np.uint32(1)) * _MULTIPLIER
    rolling ^= rolling >> np.uint32(15)
    step = 1
    while step < WINDOW:  # sum of the last 1, 2, 4, … 16 characters, older ones shifted further
        older = np.zeros_like(rolling)
        older[step:] = rolling[:-step]
        rolling = rolling + (older << np.uint32(step))
        step *= 2
    rolling ^= rolling >> np.uint32(16)
    out, last = [], 0
    for end in ((np.flatnonzero((rolling & np.uint32(MASK)) == 0) + 1).tolist() + [n]):
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if end - last >= MIN_CHUNK or end == n and end > last:
            out.append(end)
            last = end
    return out


class Encoder:
    """Encodes texts as the tokenizer does, chunk by chunk, and decodes ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items() if t.content}
        self.pieces = {}
        back = {chr(c): bytes([b]) for b, c in _BYTES.items()} | {chr(b): bytes([b]) for b in _PRINTED}
        self.chunked = _byte_level(json.loads(self.tokenizer.to_str()))
        if self.chunked:
            self.pieces = {
                i: b"".join(map(back.__getitem__, piece))
                for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            } | {i: t.encode() for t, i in self.added.items()}
        self.cache: OrderedDict[str, Chunk] = OrderedDict()
        self.cached = 0
        self.words: dict[str, bytes] = {}
        self.encoded = self.reused = 0

    def _split(self, text: str) -> Chunk:
        """Ids and pre-tokens of a text on its own."""
        if not _LATIN.fullmatch(text):
            enc = self.tokenizer.encode(text, add_special_tokens=False)
            firsts = np.flatnonzero(np.diff(np.array(enc.word_ids, np.int64), prepend=-1))
            offsets = enc.offsets
            starts = [offsets[i][0] for i in firsts.tolist()]
            return Chunk(np.array(enc.ids, np.uint32), np.array(starts, np.int32), firsts.astype(np.int32))
        words = _WORDS.findall(text)
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        packed = list(map(known.get, words))
        if None in packed:
            for i, p in enumerate(packed):
                if p is None:
                    packed[i] = known.get(words[i]) or self._spell(words[i])
        starts, firsts = np.zeros((2, len(words) + 1), np.int32)
        np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), out=starts[1:])
        np.cumsum(np.fromiter(map(len, packed), np.int32, len(words)) // 4, out=firsts[1:])
        return Chunk(np.frombuffer(b"".join(packed), "<u4"), starts[:-1], firsts[:-1])

    def _spell(self, word: str) -> bytes:
        """Packed ids of one pre-token, remembered."""
        spelled = word.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(spelled)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= WORD_CHARS:
            self.words[word] = packed
        return packed

    def _chunk(self, text: str) -> Chunk:
        found = self.cache.get(text)
        if found is not None:
            self.cache.move_to_end(text)
            self.reused += 1
            return found
        found = self._split(text)
        self.encoded += 1
        self.cache[text] = found
        self.cached += len(text)
        while self.cached > CACHED:
            old, _ = self.cache.popitem(last=False)
            self.cached -= len(old)
        return found

    @staticmethod
    def _certain(chunk: Chunk, length: int, at_least: int) -> int:
        """Index of the last pre-token start that does not depend on where the text ends."""
        starts = chunk.starts
        k = len(starts) - 1
        while k > at_least and not (
            starts[k] <= length - 1 and starts[k - 1] <= length - LOOKAHEAD
        ):
            k -= 1
        return k

    def _plain(self, text: str) -> list[np.ndarray]:
        """Ids of a text without added tokens."""
        ends = cuts(text)
        if len(ends) <= 1:
            return [self._chunk(text).ids] if text else []
        out: list[np.ndarray] = []
        # `left`: what is known from pre-token `at` on, a chunk that begins at `origin`
        origin, left, at, end = 0, self._chunk(text[: ends[0]]), 0, ends[0]
        n, taken = 1, 1  # chunks done, and chunks that the next right side takes
        while n < len(ends):
            right_end = ends[min(n + taken, len(ends)) - 1]
            n += taken
            k = self._certain(left, end - origin, at)
            out.append(left.ids[left.firsts[at] : left.firsts[k]])
            begin = origin + int(left.starts[k])
            if taken > 1:  # a pre-token is open that no chunk has ended
                origin, left, at, end = begin, self._split(text[begin:right_end]), 0, right_end
                taken = 1 if self._certain(left, end - origin, 0) else 2 * taken
                continue
            right = self._chunk(text[end:right_end])
            known = {int(s): i for i, s in enumerate(right.starts)}
            reach, joined = 64, None
            while joined is None:
                stop = min(end + reach, right_end)
                again = self._split(text[begin:stop])
                sure = self._certain(again, stop - begin, 0)
                for j in range(1, sure + 1):
                    meets = known.get(begin + int(again.starts[j]) - end)
                    if meets is not None:
                        joined = (again.ids[: again.firsts[j]], meets)
                        break
                if joined is None and stop == right_end:
                    break  # the whole right chunk belongs to the repaired part
                reach *= 4
            if joined is None:
                origin, left, at, taken = begin, again, 0, 2
            else:
                out.append(joined[0])
                origin, left, at = end, right, joined[1]
            end = right_end
        out.append(left.ids[left.firsts[at] :])
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, special tokens recognised, none added."""
        if not self.chunked:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        parts: list[np.ndarray] = []
        at = 0
        while True:
            hits = [(text.find(t, at), -len(t), t) for t in self.added]
            hits = sorted(h for h in hits if h[0] >= 0)
            to = hits[0][0] if hits else len(text)
            parts += self._plain(text[at:to])
            if not hits:
                break
            parts.append(np.array([self.added[hits[0][2]]], np.uint32))
            at = to + len(hits[0][2])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included: the bytes of their pieces."""
        if not self.chunked:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        whole = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        return whole.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process: its chunk cache serves all tasks of the worker."""
    return Encoder(path)


def encode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, packed) of every row.
    `tokenizer_path` is a file that every executor has, as part of an installed package."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, counts, packed = encoder(tokenizer_path), [], []
        for text in texts(batch):
            ids = tool.encode(text)
            counts.append(len(ids))
            packed.append(ids.astype("<u4").tobytes())
        return pa.record_batch(
            [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
            ["doc_id", "n_tokens", "ids"])

    return map_batches(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with a column `decoded`, the text of its packed ids."""
    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = encoder(tokenizer_path)
        out = [tool.decode(np.frombuffer(v.as_py() or b"", "<u4")) for v in column(batch, ids_col)]
        return pa.record_batch(
            [*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return map_batches(encoded, run, f"{fields}, decoded string")


def digests(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text they decode to. Encodes and
    decodes in one pass, so that a task runs one Python worker and texts travel once."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, counts, ids_hash, text_hash = encoder(tokenizer_path), [], [], []
        for text in texts(batch):
            ids = tool.encode(text)
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_hash.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
        return pa.record_batch(
            [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(
        rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
