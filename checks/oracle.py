"""The rules once more, as SQL text for the oracle: relational where the library works on
arrays, so that the two are independent statements of the same result."""

from __future__ import annotations

import hashlib

from veilspark import constants as C

from .registry import KEY

# The oracle's patterns have no look-around; `check` holds what takes its place.
PATTERN = dict(C.PATTERNS)
RELAXED_PHONE = r"(?:\+91[\s-]?)?[6-9]\d{9}\b"
PAIR = r"(?m)([\w.]+)\s*:\s*(.+?)(?:\s+\||$)"
PERSON = C.PERSON_SHAPE
PLACE = r"\b(?:" + "|".join(C.PLACES) + r")\b"


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def spans(base: str, pattern: str, keys: str = "src, unit_id") -> str:
    """Matches with half-open positions s, e."""
    return f"""
SELECT {keys}, text, s, s + length(value) AS e, value FROM (
  SELECT {keys}, text, m[i] AS value,
    CAST(list_sum(list_transform(f[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {keys}, text, regexp_extract_all(text, '{pattern}') AS m,
      string_split_regex(text, '{pattern}') AS f FROM {base}) WHERE len(m) > 0))
"""


def typed_spans(base: str, pii_type: str, strict: bool, keys: str) -> str:
    """Spans of one type with its acceptance rule."""
    pattern = RELAXED_PHONE if pii_type == "PHONE_NUMBER" and not strict else PATTERN[pii_type]
    found = spans(base, pattern, keys)
    rule = {
        "AADHAAR": "length(replace(replace(value, ' ', ''), '-', '')) = 12",
        "UPI_ID": "substr(text, e + 1, 1) <> '.'",
    }.get(pii_type, "true")
    if not strict and pii_type == "AADHAAR":
        rule += (" AND NOT (s > 0 AND substr(text, s, 1) = '+'"
                 " AND regexp_full_match(value, '91[6-9][0-9]{9}'))")
    if not strict and pii_type == "PHONE_NUMBER":
        rule += r" AND NOT (s > 0 AND regexp_matches(substr(text, s, 1), '[\w+]'))"
    return f"SELECT * FROM ({found}) WHERE {rule}"


def label(left: str) -> str:
    """Label in front of a candidate, from the text left of it."""
    raw = rf"regexp_extract({left}, '([^|\n,]*):[^:]*$', 1)"
    return rf"replace(lower(regexp_replace({raw}, '^\s+|\s+$', '', 'g')), ' ', '_')"


def parts(lab: str) -> str:
    return rf"list_filter(string_split_regex(replace(replace(lower({lab}), '.', ' '), '_', ' '), '\s+'), lambda x: x <> '')"


def left(text: str = "text", s: str = "s") -> str:
    return f"substr({text}, greatest({s} - 120, 0) + 1, least({s}, 120))"


def around(text: str = "text", s: str = "s", e: str = "e") -> str:
    return f"lower(substr({text}, greatest({s} - 120, 0) + 1, least({s}, 120) + {e} - {s} + 120))"


def non_pii(ps: str) -> str:
    return f"(len({ps}) > 0 AND len(list_filter({ps}, lambda x: NOT list_contains({quoted(C.NON_PII_PARTS)}, x))) = 0)"


def keyword(lab: str, t: str) -> str:
    return f"len(list_filter({quoted(C.CONTEXT_KEYWORDS[t])}, lambda k: contains({lab}, k) OR contains(k, {lab}))) > 0"


def label_matches(lab: str, ps: str, t: str) -> str:
    rule = f"NOT {non_pii(ps)} AND {keyword(lab, t)}"
    if t == "PERSON_NAME":
        rule += f" AND NOT list_has_any({ps}, {quoted(C.NAME_SUPPRESS_PARTS)})"
    if t == "ADDRESS":
        rule += f" AND list_has_any({ps}, {quoted(C.ADDRESS_PARTS)})"
    return f"({rule})"


def any_keyword(win: str, words) -> str:
    return f"len(list_filter({quoted(words)}, lambda k: contains({win}, k))) > 0"


def free_context(win: str, t: str) -> str:
    return any_keyword(win, C.CONTEXT_KEYWORDS[t] + C.CONTEXT_KEYWORDS["PERSON_NAME"])


def per_type(expr, default: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN {expr(t)}" for t in C.CONTEXT_REQUIRED)
    return f"CASE pii_type {cases} ELSE {default} END"


def acceptable(v: str, person: bool) -> str:
    rule = (f"NOT list_contains({quoted(C.GEO_EXCLUSIONS)}, lower(trim({v}))) AND NOT "
            f"(contains({v}, '.') AND regexp_full_match({v}, '[\\pL\\pN]+(?:\\.[\\pL\\pN]+)*'))")
    if person:
        rule += (f" AND length({v}) >= 2 AND regexp_full_match(regexp_replace({v}, '[ .-]', '', 'g'), '\\pL+')"
                 f" AND (contains({v}, ' ') OR length({v}) >= 4)")
    else:
        rule += f" AND length({v}) >= 5"
    return rule


def pairs(base: str, keys: str) -> str:
    """label, value, s, e of `label: value` pairs; positions are those of the trimmed value."""
    found = spans(base, PAIR, keys).replace("text, s, s + length(value) AS e, value", "text, s, value")
    lead = r"regexp_extract(value, '^[\w.]+\s*:\s*')"
    body = rf"regexp_replace(regexp_replace(value, '\s+\|$', ''), '^[\w.]+\s*:\s*', '')"
    return rf"""
SELECT {keys}, text, label, value, s, s + length(value) AS e FROM (
  SELECT {keys}, text, lower(regexp_extract(value, '^[\w.]+')) AS label, s + length({lead}) AS s,
    regexp_replace({body}, '^\s+|\s+$', '', 'g') AS value
  FROM ({found})) WHERE length(value) >= 2
"""


def name_field(ps: str, v: str) -> str:
    return (f"(list_has_any({ps}, {quoted(C.NAME_PARTS)}) AND NOT list_has_any({ps}, {quoted(C.NAME_SUPPRESS_PARTS)})"
            rf" AND len(list_filter(string_split_regex({v}, '\s+'), lambda w: regexp_full_match(w, '\pL+'))) > 0)")


def address_field(ps: str, v: str) -> str:
    return (f"(NOT list_has_any({ps}, {quoted(C.NAME_PARTS)}) AND list_has_any({ps}, {quoted(C.ADDRESS_PARTS)})"
            f" AND length({v}) >= 5)")


def structured(base: str, keys: str) -> str:
    ps = parts("label")
    return f"""
SELECT {keys}, text, s, e, value, CASE WHEN {name_field(ps, 'value')} THEN 'PERSON_NAME' ELSE 'ADDRESS' END AS pii_type
FROM ({pairs(base, keys)}) WHERE {name_field(ps, 'value')} OR {address_field(ps, 'value')}
"""


def detection_ctes(base: str, keys: str, strict: bool, ner: bool = True) -> dict[str, str]:
    """CTEs raw, judged, kept and det(keys, s, e, rank, pii_type, confidence, method, value)."""
    out = {}
    rows = []
    for t in C.PATTERNS:
        rows.append(
            f"SELECT {keys}, text, s, e, value, {C.RANK[t]} AS rank, '{t}' AS pii_type, "
            f"CAST({C.CONFIDENCE[t]} AS DOUBLE) AS confidence, 'regex' AS method FROM ({typed_spans(base, t, strict, keys)})"
        )
    if ner:
        for t, pattern in (("PERSON_NAME", PERSON), ("ADDRESS", PLACE)):
            rows.append(
                f"SELECT {keys}, text, s, e, value, {C.NER_RANK} AS rank, '{t}' AS pii_type, "
                f"CAST({C.NER_CONFIDENCE[t]} AS DOUBLE) AS confidence, 'ner' AS method "
                f"FROM ({spans(base, pattern, keys)}) WHERE {acceptable('value', t == 'PERSON_NAME')}"
            )
    rows.append(
        f"SELECT {keys}, text, s, e, value, {C.STRUCTURED_RANK} AS rank, pii_type, "
        f"CAST({C.STRUCTURED_CONFIDENCE} AS DOUBLE) AS confidence, 'structured' AS method FROM ({structured(base, keys)})"
    )
    out["raw"] = " UNION ALL ".join(rows)

    def relabel(t):
        order = C.CONTEXT_REQUIRED if strict else ["PERSON_NAME", "ADDRESS"]
        whens = " ".join(
            f"WHEN {label_matches('lab', 'ps', o)} THEN '{o}'" for o in order if o != t
        )
        return f"CASE {whens} END" if whens else "NULL"

    out["judged"] = f"""
SELECT *, CASE WHEN method = 'structured' OR NOT list_contains({quoted(C.CONTEXT_REQUIRED)}, pii_type) THEN 'pass'
  WHEN lab <> '' AND {per_type(lambda t: label_matches('lab', 'ps', t), 'false')} THEN 'boost'
  WHEN lab <> '' AND method = 'ner' THEN coalesce({per_type(relabel, 'NULL')}, 'drop')
  WHEN lab <> '' THEN 'drop'
  WHEN {per_type(lambda t: free_context('win', t), 'false')} THEN 'pass' ELSE 'drop' END AS verdict
FROM (SELECT *, {parts('lab')} AS ps FROM (
  SELECT *, {label(left())} AS lab, {around()} AS win FROM raw))
"""
    boosted = "CASE WHEN verdict = 'boost' THEN least(CAST(1.0 AS DOUBLE), confidence + CAST(0.1 AS DOUBLE)) ELSE confidence END"
    final = "CASE WHEN verdict IN ('pass', 'boost') THEN pii_type ELSE verdict END"
    key_list = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in key_list)
    source = "judged" if strict else "(SELECT * FROM judged WHERE verdict <> 'drop')"
    clash = f"{same} AND greatest(a.s, b.s) < least(a.e, b.e)"
    out["x0"] = f"SELECT * FROM {source} WHERE rank <= 5"
    for i, rank in enumerate((6, 7, 8)):
        out[f"x{i + 1}"] = (
            f"SELECT * FROM x{i} UNION ALL SELECT * FROM {source} a WHERE rank = {rank} "
            f"AND NOT EXISTS (SELECT 1 FROM x{i} b WHERE {clash})"
        )
    out["kept"] = (
        f"SELECT {keys}, s, e, rank, {final} AS pii_type, {boosted} AS confidence, method, value FROM "
        f"(SELECT * FROM x3 UNION ALL SELECT * FROM {source} WHERE rank > 8) WHERE verdict <> 'drop'"
    )
    out["sorted"] = (
        f"SELECT {keys}, list({{'s': s, 'e': e, 'rank': rank, 'pii_type': pii_type, 'confidence': confidence, "
        f"'method': method, 'value': value}} ORDER BY s - e, -confidence, rank, s) AS l FROM kept GROUP BY ALL"
    )
    out["chosen"] = (
        f"SELECT {keys}, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN "
        "len(list_filter(acc, lambda d: greatest(d.s, x[1].s) < least(d.e, x[1].e))) > 0 "
        "THEN acc ELSE list_concat(acc, x) END) AS l FROM sorted"
    )
    out["det"] = (
        f"SELECT {keys}, d.s AS s, d.e AS e, d.rank AS rank, d.pii_type AS pii_type, d.confidence AS confidence, "
        f"d.method AS method, d.value AS value FROM (SELECT {keys}, unnest(l) AS d FROM chosen)"
    )
    return out


def hmac_hex(message: str, key: str = KEY) -> str:
    raw = key.encode()
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    block = raw.ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in block).hex()
    opad = bytes(b ^ 0x5C for b in block).hex()
    return (f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || CAST({message} AS BLOB))))")


def prefix(t: str = "pii_type") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TOKEN_PREFIX.items())
    return f"CASE {t} {whens} ELSE {t} END"


def vault_ctes(det: str = "det") -> dict[str, str]:
    """CTE vault(file_id, value, pii_type, n_found, token) from detections."""
    digest = "upper(" + hmac_hex("concat(CAST(file_id AS STRING), chr(31), value)") + ")"
    return {
        "firsts": f"SELECT file_id, value, arg_min(pii_type, {{'a': -confidence, 'b': rank, 'c': unit_id, 'd': s}}) AS pii_type, "
                  f"count(*) AS n_found FROM {det} GROUP BY file_id, value",
        "digests": f"SELECT *, {prefix()} AS prefix, {digest} AS digest FROM firsts",
        "vault": "SELECT file_id, value, pii_type, n_found, concat(prefix, '_', translate(substr(digest, 1, 24), '0123456789ABCDEF', 'ABCDEFGHIJKLMNOP')) AS token FROM digests",
    }
