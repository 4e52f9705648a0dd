"""Text helpers: Unicode-aware patterns, trimming, label words.

These functions take and return SQL expression text, to be used with `F.expr` or
`selectExpr`. Detection is one expression of several thousand nodes; as text it reaches the
JVM in a few calls, where a Column per node would cost seconds of planning per query.
"""

from __future__ import annotations

from collections.abc import Iterable

# Character classes as a Unicode-aware pattern means them, written for java.util.regex.
# (Java's own \w counts combining vowel signs as word characters, so "की98…" would have
# no boundary before the digits.)
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
EDGES = f"^[{SPACE}]+|[{SPACE}]+$"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _translate(pattern: str, boundary: str, digit: str, space: str, word: str) -> str:
    out, i, in_class = "", 0, False
    while i < len(pattern):
        two, step = pattern[i:i + 2], 2
        if two == r"\b":
            out += boundary
        elif two == r"\d":
            out += digit
        elif two == r"\s":
            out += space if in_class else f"[{space}]"
        elif two == r"\w":
            out += word if in_class else f"[{word}]"
        elif two.startswith("\\"):
            out += two
        else:
            step = 1
            in_class = {"[": True, "]": False}.get(pattern[i], in_class)
            out += pattern[i]
        i += step
    return out


def unicode_pattern(pattern: str) -> str:
    r"""Give `\b \d \s \w` of a pattern the Unicode meaning above."""
    return _translate(pattern, BOUNDARY, r"\p{Nd}", SPACE, WORD)


def ascii_pattern(pattern: str) -> str:
    r"""The same pattern for texts of ASCII characters only."""
    return _translate(pattern, r"\b", "[0-9]", r"\s\x1c-\x1f", "A-Za-z0-9_")


def literal(value: str) -> str:
    """SQL literal of any text, where possible without escapes."""
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rlike(e: str, pattern: str) -> str:
    return f"({e} RLIKE {literal(pattern)})"


def strip(e: str) -> str:
    """Remove white space of any kind from both ends."""
    return f"regexp_replace({e}, {literal(EDGES)}, '')"


def has_text(e: str) -> str:
    """True unless the value is null or only white space."""
    return f"coalesce({rlike(e, f'[^{SPACE}]')}, false)"


def words(e: str) -> str:
    # split at one character: `split` compiles any other pattern anew for each value
    blanks = f"regexp_replace({e}, {literal(f'[{SPACE}]+')}, ' ')"
    return f"array_remove(split({blanks}, ' '), '')"


def label_parts(e: str) -> str:
    """Words of a label: `Location.Street_Name` -> [location, street, name]."""
    return words(f"translate(lower({e}), '._', '  ')")


def one_of(e: str, values: Iterable[str]) -> str:
    return f"({e} IN ({', '.join(map(literal, values))}))"


def some_of(words_: str, values: Iterable[str]) -> str:
    """Does an array of words hold one of the values? Their set is built once, not for each array."""
    return f"exists({words_}, w -> {one_of('w', values)})"


def contains_any(e: str, needles: Iterable[str]) -> str:
    needles = list(dict.fromkeys(needles))
    # what holds a longer one holds the shorter one in it, too
    least = [n for n in needles if not any(m != n and m in n for m in needles)]
    return "(" + " OR ".join(f"contains({e}, {literal(n)})" for n in least) + ")"
