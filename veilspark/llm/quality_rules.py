"""Line-first cleaning: rules judge single lines, failing lines go, and a document goes if it
fails the base rules or loses too much of its text.

Lines are cut at \\n; a line without a word is neither judged nor counted. A line fails by

- symbols      more than 3 characters of `#*$%&|<>` in 10 words;
- navigation   at least 2 words that are only separators (| > » · •), making up 1 word in 5;
- shouting     8 or more ASCII letters, more than 7 in 10 of them capitals, and "!" in 1 word in 3;
- repetition   10 or more words, half of them or more the same word;
- boilerplate  one of the phrases of web pages below;
- punctuation  8 or more words without any sentence mark (`STOPS`, of all scripts that have one)
               anywhere; a line mostly in a script without such marks (Thai, Khmer, Tibetan, …), or in
               one that is not known, is not judged by it;
- duplicate    equal to an earlier line of the document.

The document is rejected if more than half of its word characters stood in failing lines.

Cases. Null or empty text: no words, all counts 0, base rules fail. Repeated rows are judged
alike. Very long texts are judged whole, one at a time. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_arrow, map_batches, take_columns, texts

# Characters and phrases the rules look for.
SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(["|", ">", "»", "·", "•"])
STOPS = ".!?…。！？:;।॥؟۔؛։՞՜።፧፨׃᙮"
# Scripts whose sentences end in one of these marks, and characters common to all scripts.
MARKED = "!-~¡-ʯ\u0370-\u0dff\u1200-\u139f\u1400-\u167f\u1e00-\u1fff\u2010-\u2bff\u3000-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff00-\uffef"
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service",
    "terms of use", "javascript is disabled", "enable javascript", "click here to", "sign up for our",
    "subscribe to our", "skip to content", "back to top", "lorem ipsum",
)

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
WINDOW = 5

_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_STOP, _MARKED = re.compile("[" + STOPS + "]"), re.compile("[" + MARKED + "]")
_CAPITAL, _SMALL = re.compile("[A-Z]"), re.compile("[a-z]")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # bytes split at exactly the six ASCII spaces


def chars_in(words: list[bytes]) -> int:
    """Code points in UTF-8 words: all bytes but continuation bytes."""
    return len(b"".join(words).decode())


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which occurs more than once in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, covered_to = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW - max(at, covered_to)
            covered_to = at + WINDOW
    return total


def line_fails(line: str, words: list[bytes]) -> bool:
    """Does a line with words fail a rule of its own (all but `duplicate`)?"""
    n = len(words)
    if 10 * len(_SYMBOL.findall(line)) > 3 * n:
        return True
    if n >= 2:
        separators = sum(w.decode() in SEPARATORS for w in words)
        if separators >= 2 and 5 * separators >= n:
            return True
    capitals = len(_CAPITAL.findall(line))
    letters = capitals + len(_SMALL.findall(line)) if capitals >= 6 else 0
    if letters >= 8 and 10 * capitals > 7 * letters and 3 * line.count("!") >= n:
        return True
    if n >= 10 and 2 * Counter(words).most_common(1)[0][1] >= n:
        return True
    if n >= 8 and not _STOP.search(line) and (line.isascii() or 2 * len(_MARKED.findall(line)) >= chars_in(words)):
        return True
    return bool(_BOILERPLATE.search(line.lower()))


def judge(text: str) -> tuple[dict, str]:
    """The counts and verdict of one text, and the text without its failing lines."""
    words = words_of(text)
    seen, n_dup, lost, lines = set(), 0, 0, []
    for line in text.split("\n"):
        own = words_of(line)
        if own:
            again = line in seen
            seen.add(line)
            n_dup += again
            if again or line_fails(line, own):
                lost += chars_in(own)
                continue
        lines.append(line)
    n, chars, repeated = len(words), chars_in(words), repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": len(_SYMBOL.findall(text)),
        "n_dup_lines": n_dup, "n_repeat_words": repeated, "base_failed": base_failed,
        "kept": not base_failed and 100 * lost <= MAX_LOST_PERCENT * chars, "lost_chars": lost,
    }, "\n".join(lines)


_SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, lost_chars bigint"
)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and lost_chars (word characters in failing
    lines) of every row. One narrow pass."""
    rows = take_columns(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.Table.from_pylist([judge(t)[0] for t in texts(batch)]).to_batches()[0]
        return pa.record_batch([column(batch, "doc_id"), *found.columns], ["doc_id", *found.schema.names])

    kind = dict(rows.dtypes)["doc_id"]
    return map_batches(rows, run, f"doc_id {kind}, {_SCHEMA}")


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The kept rows with all their columns, their text without the failing lines.
    `chars_col` names a column that holds the text's length, which is set anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cleaned = [], []
            for text in texts(batch, text_col):
                verdict, rest = judge(text)
                keep.append(verdict["kept"])
                if verdict["kept"]:
                    cleaned.append(rest)
            batch = batch.filter(pa.array(keep, pa.bool_()))
            new = {text_col: pa.array(cleaned, pa.string())}
            if chars_col:
                kind = batch.schema.field(chars_col).type
                new[chars_col] = pa.array([len(t) for t in cleaned], pa.int64()).cast(kind)
            names = batch.schema.names
            yield pa.record_batch(
                [new.get(n, c) for n, c in zip(names, batch.columns)],
                schema=pa.schema([pa.field(n, new[n].type if n in new else batch.schema.field(n).type)
                                  for n in names]))

    return map_arrow(docs, run, docs.schema)
