"""Positions of pattern matches, without a UDF. SQL expression text in and out.

A text is cut into pieces in one pass: the pattern's matches are wrapped in a marker
character and the result is split at the marker, so gaps and matches alternate. The start of
a match is the length of all pieces before it.
"""

from __future__ import annotations

from .text import ascii_pattern, literal, unicode_pattern

SPANS = "array<struct<start:int,end:int,value:string>>"
NO_SPANS = f"cast(array() AS {SPANS})"
NO_PIECES = "cast(array() AS array<string>)"

# A control character no pattern names and no class holds; another of its kind takes its
# place in a text that already has it, which changes neither matches nor offsets.
MARK, OTHER = "char(1)", "char(2)"


def searchable(text: str) -> str:
    """The text without the marker character."""
    return f"CASE WHEN contains({text}, {MARK}) THEN translate({text}, {MARK}, {OTHER}) ELSE {text} END"


def is_ascii(text: str) -> str:
    return f"(octet_length({text}) = length({text}))"


def cut(text: str, pattern: str, gate: str | None = None) -> str:
    """Pieces gap, match, gap, … of a `searchable` text; none if the cheap `gate` fails.

    `pattern` is written with the classes of `functions.text`. In pure ASCII texts the plain
    classes of Java mean the same and are tested faster, so those texts use them.
    """
    def pieces(java_pattern):
        marked = f"regexp_replace({text}, {literal(java_pattern)}, concat({MARK}, '$0', {MARK}))"
        return f"split({marked}, {MARK}, -1)"

    test = f"{text} IS NOT NULL" + (f" AND {gate}" if gate else "")
    return (
        f"CASE WHEN NOT ({test}) THEN {NO_PIECES} WHEN {is_ascii(text)} "
        f"THEN {pieces(ascii_pattern(pattern))} ELSE {pieces(unicode_pattern(pattern))} END"
    )


# Long texts are addressed through blocks of this many characters, since finding the n-th
# character of a text takes n steps.
BLOCK = 1024
# `aggregate` copies its state at every step, so a state that gathers results must stay small:
# long arrays are folded in chunks of this many.
CHUNK = 128


def blocks(text: str) -> str:
    """A text as an array of blocks of equal length (the last one may be shorter).

    `transform` keeps a projection with blocks, and so with all patterns, out of whole-stage code:
    there it is one method, too long for the JVM to compile, and runs interpreted at half the speed."""
    return (
        f"transform(array({text}), t -> CASE WHEN length(t) <= {BLOCK} THEN array(t) "
        f"ELSE regexp_extract_all(t, r'(?s).{{1,{BLOCK}}}', 0) END)[0]"
    )


def slice_text(text_blocks: str, at: str, length: str) -> str:
    """`length` characters from offset `at`, fewer at the end of the text."""
    first = f"cast(({at}) div {BLOCK} AS int)"
    last = f"cast(({at} + {length} - 1) div {BLOCK} AS int)"
    some = f"array_join(slice({text_blocks}, {first} + 1, {last} - {first} + 1), '')"
    return (
        f"CASE WHEN size({text_blocks}) = 1 THEN substring({text_blocks}[0], {at} + 1, {length}) "
        f"ELSE substring({some}, ({at}) % {BLOCK} + 1, {length}) END"
    )


def char_at(text_blocks: str, at: str) -> str:
    """The character at offset `at`, "" past the end."""
    block = f"coalesce(get({text_blocks}, cast(({at}) div {BLOCK} AS int)), '')"
    return f"substring({block}, ({at}) % {BLOCK} + 1, 1)"


def chunks(array: str) -> str:
    """An array as an array of chunks."""
    count = f"sequence(0, (size({array}) - 1) div {CHUNK})"
    many = f"transform({count}, i -> slice({array}, cast(i * {CHUNK} + 1 AS int), {CHUNK}))"
    return f"CASE WHEN size({array}) <= {CHUNK} THEN array({array}) ELSE {many} END"


# So many pieces are located by adding up the lengths before each match, without a state.
FEW_PIECES = 33


def locate(pieces: str) -> str:
    """Spans (start, end, value) with half-open character offsets, from `cut()` output. One hit, and
    a few, are located without `aggregate`, whose state is copied with all its spans at every step."""
    first = f"length({pieces}[0])"
    one = f"array(struct({first} AS start, {first} + length({pieces}[1]) AS `end`, {pieces}[1] AS value))"
    before = "aggregate(slice(n, 1, i), 0, (a, l) -> a + l)"
    few = f"""transform(array(transform({pieces}, p -> length(p))), n -> transform(
      transform(sequence(1, size({pieces}) - 2, 2), i -> struct(i AS i, {before} AS start)),
      x -> struct(x.start AS start, x.start + n[x.i] AS `end`, {pieces}[x.i] AS value)))[0]"""
    item = "array(struct(w.pos AS start, w.pos + length(p) AS `end`, p AS value))"
    walked = f"""aggregate({chunks(pieces)},
      struct(0 AS pos, false AS hit, {NO_SPANS} AS done),
      (o, chunk) -> aggregate(chunk,
        struct(o.pos AS pos, o.hit AS hit, {NO_SPANS} AS done),
        (w, p) -> struct(w.pos + length(p) AS pos, NOT w.hit AS hit,
          CASE WHEN w.hit THEN concat(w.done, {item}) ELSE w.done END AS done),
        r -> struct(r.pos AS pos, r.hit AS hit, concat(o.done, r.done) AS done)),
      o -> o.done)"""
    return (f"CASE WHEN size({pieces}) <= 1 THEN {NO_SPANS} WHEN size({pieces}) = 3 THEN {one} "
            f"WHEN size({pieces}) <= {FEW_PIECES} THEN {few} ELSE {walked} END")


def with_original_values(text_blocks: str, spans: str) -> str:
    """Spans with values from the text itself. Needed only for patterns that match any
    character, and only in texts in which `searchable` had to replace the marker."""
    value = slice_text(text_blocks, "s.start", "(s.`end` - s.start)")
    return (
        f"transform({spans}, s -> struct(s.start AS start, s.`end` AS `end`, "
        f"CASE WHEN contains(s.value, {OTHER}) THEN {value} ELSE s.value END AS value))"
    )
