"""The same results in SQL, where SQL expresses the method."""

from __future__ import annotations

from . import quality_rules as rules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BOILERPLATE = " OR ".join(f"contains(low, {_text(p)})" for p in rules.BOILERPLATE)
_SEPARATORS = "[" + ", ".join(map(_text, sorted(rules.SEPARATORS))) + "]"
_SPACE = r"[\x20\x09-\x0D]"

LINE_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    string_split(text, chr(10)) AS lines FROM docs),
flat AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
lines AS (
  SELECT doc_id, line, lower(line) AS low, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM flat WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
measured AS (
  SELECT *, len(w) AS n, length(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    len(list_filter(w, lambda x: list_contains({_SEPARATORS}, x))) AS separators,
    length(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(line, '[^!]', '', 'g')) AS shouts,
    list_max(map_values(list_histogram(w))) AS most FROM lines),
judged AS (
  SELECT doc_id, chars, again,
    again OR 10 * symbols > 3 * n OR (n >= 2 AND separators >= 2 AND 5 * separators >= n)
    OR (capitals >= 6 AND letters >= 8 AND 10 * capitals > 7 * letters AND 3 * shouts >= n)
    OR (n >= 10 AND 2 * most >= n) OR (n >= 8 AND NOT regexp_matches(line, '[{rules.STOPS}]')
      AND 2 * length(regexp_replace(line, '[^{rules.MARKED}]', '', 'g')) >= chars)
    OR {_BOILERPLATE} AS fails FROM measured),
by_line AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines,
    coalesce(sum(chars) FILTER (fails), 0) AS lost_chars FROM judged GROUP BY doc_id),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM split),
windows AS (
  SELECT doc_id, pos, w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2,
    lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (
  SELECT doc_id, pos, w4 IS NOT NULL AND
    count(*) OVER (PARTITION BY doc_id, w0, w1, w2, w3, w4) > 1 AS twice FROM windows),
covered AS (
  SELECT doc_id, max(twice::int) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM marked),
by_word AS (SELECT doc_id, sum(hit) AS n_repeat_words FROM covered GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, len(words)::bigint AS n_words,
    length(regexp_replace(text, '{_SPACE}', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
    coalesce(lost_chars, 0)::bigint AS lost_chars
  FROM split s LEFT JOIN by_line USING (doc_id) LEFT JOIN by_word USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND 100 * lost_chars <= 50 * word_chars AS kept FROM counted
"""

_VECTORS = """
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

TOP_K = f"""
WITH {_VECTORS},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored) WHERE rank <= 5
"""

NEGATIVES = f"""
WITH {_VECTORS},
l AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM v WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM l a JOIN l c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
      AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
WHERE rank <= 10
"""

ORACLES = {
    "op7_line_rules": LINE_RULES, "op12_cover_tree_top_k": TOP_K, "op13_window_negatives": NEGATIVES,
}
