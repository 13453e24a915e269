"""Excerpts against the texts they are from, over whole tables (survey T10)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from waymark.functions import excerpts
from waymark.queries.registry import FIXTURES, SQL_ONLY, Tables, query


def _words(*places: int) -> str:
    return " || ' ' || ".join(f"split_part(text, ' ', {k})" for k in places)


#: Quotations by the row: whole, joined in several ways, run together, cut by characters, capitals, turned round, notes about a page.
FIXTURES["quoted"] = f"""
SELECT doc_id, text, CASE doc_id % 15
  WHEN 0 THEN {_words(3, 4, 5, 6, 7)} WHEN 1 THEN {_words(3, 4, 5, 6)} || ' … ' || {_words(9, 10)} WHEN 2 THEN translate({_words(2, 3, 4)}, 'aeiou', 'AEIOU') || ' / ' || {_words(12, 13)} || ' — ' || {_words(1, 2)} WHEN 3 THEN replace({_words(4, 5, 6)}, ' ', '')
  WHEN 4 THEN substring(text, 9, 195) WHEN 5 THEN substring(text, 3, 60) WHEN 6 THEN {_words(5, 6, 7)} || ' | ' || {_words(8)} || ' ; ' || {_words(60)} WHEN 7 THEN 'The site footer has ' || {_words(4)} WHEN 8 THEN NULL WHEN 9 THEN ' … '
  WHEN 10 THEN {_words(3, 4, 6)} || '...' || {_words(7)} WHEN 11 THEN replace({_words(2, 3)}, ' ', '') || '; 7 am' WHEN 12 THEN {_words(9)} || ' + ' || {_words(3)} || ' + ' || {_words(40)} || ' + ' || {_words(10)}
  WHEN 13 THEN substring(text, 14, 120) || ' … ' || substring(text, 200, 90) ELSE {_words(1)} || ' ... ' || {_words(2, 3)} END AS excerpt
FROM {{documents}}"""


def _e(pattern: str) -> str:
    return "'" + pattern.replace("{", "{{").replace("}", "}}") + "'"


def _spaced(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), {_e(excerpts.WORD)}), ' ')"


def _squashed(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([^0-9]) ', '\1', 'g'), ' ([^0-9])', '\1', 'g')"


def _marked(x: str, inner: str) -> str:
    """Runs of these characters in marks, so a run is whole by them; at an end that is none of them there is no mark."""
    return rf"regexp_replace({x}, '([{inner}]+)', '⟨\1⟩', 'g')"


def _split(x: str, joint: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {_e(joint)}), lambda p: trim(p, ' ' || chr(10) || chr(13) || chr(9))), lambda p: p <> '')"


#: Every reading's parts in order, with the places at which they stand; then one step for each part.
SQL_ONLY["excerpt_parts"] = rf"""
WITH RECURSIVE q AS (SELECT doc_id, coalesce(excerpt, '') AS x, {_spaced("coalesce(text, '')")} AS plain FROM {{quoted}}),
p AS (SELECT doc_id, x, {_marked("plain", "a-z0-9")} AS plain, {_marked(_squashed("plain"), "0-9")} AS dense FROM q),
rough AS (SELECT doc_id, x, {_split("x", excerpts.JOINTS)} AS l1 FROM p),
fine AS (SELECT doc_id, x, l1, flatten(list_transform(l1, lambda y: {_split("y", excerpts.FINE_JOINTS)})) AS l2 FROM rough),
readings AS (SELECT doc_id, x, 0 AS r, [x] AS l FROM fine UNION ALL SELECT doc_id, x, 1, CASE WHEN len(l1) > 0 THEN l1 ELSE [x] END FROM fine UNION ALL SELECT doc_id, x, 2, CASE WHEN len(l2) > 0 THEN l2 ELSE [x] END FROM fine),
parts AS (SELECT doc_id, r, len(l) AS total, length(x) >= {excerpts.CAPPED} AS capped, unnest(l) AS part, generate_subscripts(l, 1) AS k FROM readings),
said AS (SELECT *, {_spaced("part")} AS s, len(flatten(list_transform({_split("part", excerpts.JOINTS)}, lambda y: {_split("y", excerpts.FINE_JOINTS)}))) <= 1 AS single FROM parts),
words AS (SELECT *, string_split(s, ' ') AS w FROM said),
cut AS (SELECT *, CASE WHEN len(w) > 3 AND regexp_matches(w[-1], '^\pL+$') THEN w[:-2] ELSE w END AS v FROM words),
forms AS (SELECT doc_id, r, total, k, s, single, length(replace(s, ' ', '')) < {excerpts.SHORT_PART} AS short, CASE WHEN capped AND k IN (1, total) THEN array_to_string(CASE WHEN len(v) > 3 AND regexp_matches(v[1], '^\pL+$') THEN v[2:] ELSE v END, ' ') ELSE '' END AS u FROM cut),
looked AS (SELECT f.*, plain, dense, {_marked("s", "a-z0-9")} AS ms, {_marked("u", "a-z0-9")} AS mu, {_marked(_squashed("s"), "0-9")} AS md FROM forms f JOIN p USING (doc_id)),
chosen AS (SELECT doc_id, r, total, k, short, plain, CASE WHEN s <> '' AND instr(plain, ms) > 0 THEN ms WHEN u <> '' THEN mu ELSE ms END AS m, s <> '' AND (instr(plain, ms) > 0 OR u <> '' AND instr(plain, mu) > 0) AS there, coalesce(NOT short AND single AND s <> '' AND instr(dense, md) > 0, false) AS runs FROM looked),
pieces AS (SELECT doc_id, r, k, m, plain, unnest(string_split(plain, m)) AS piece, generate_subscripts(string_split(plain, m), 1) AS i FROM chosen WHERE there),
begun AS (SELECT doc_id, r, k, i, sum(length(replace(replace(piece, '⟨', ''), '⟩', ''))) OVER w + (i - 1) * length(replace(replace(m, '⟨', ''), '⟩', '')) AS place, max(i) OVER (PARTITION BY doc_id, r, k) AS n FROM pieces WINDOW w AS (PARTITION BY doc_id, r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
places AS (SELECT doc_id, r, k, list(place ORDER BY place) AS spots FROM begun WHERE i < n GROUP BY ALL),
steps AS (SELECT c.doc_id, c.r, c.k, total, short, runs, coalesce(spots, []) AS spots FROM chosen c LEFT JOIN places l ON l.doc_id = c.doc_id AND l.r = c.r AND l.k = c.k),
fold AS (
  SELECT doc_id, r, 0::BIGINT AS k, max(total) AS total, NULL::HUGEINT AS place, 0 AS found, 0 AS exact FROM steps GROUP BY doc_id, r UNION ALL
  SELECT doc_id, r, k, total, CASE WHEN here IS NULL AND runs THEN NULL ELSE coalesce(here, place) END, found + CASE WHEN here IS NOT NULL OR runs THEN 1 ELSE 0 END, exact + CASE WHEN here IS NOT NULL THEN 1 ELSE 0 END
  FROM (SELECT s.doc_id, s.r, s.k, s.total, f.place, f.found, f.exact, s.runs, list_min(list_filter(s.spots, lambda x: NOT s.short OR f.place IS NULL OR abs(x - f.place) <= {excerpts.NEAR})) AS here FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.r = f.r AND s.k = f.k + 1))
SELECT doc_id, r, total, found, exact FROM fold WHERE k = total"""


@query(f"""
SELECT q.doc_id, CASE WHEN b.found = b.total THEN 'verified' WHEN regexp_matches(coalesce(q.excerpt, ''), '{excerpts.ABOUT_A_PAGE}') THEN 'not_an_excerpt' WHEN b.found > 0 THEN 'partial' ELSE 'not_found' END AS verdict,
  b.found, b.total, CASE WHEN b.found = 0 THEN '' WHEN b.exact = b.found THEN 'exact' ELSE 'loose' END AS mode
FROM {{quoted}} q JOIN (SELECT doc_id, arg_max({{{{'found': found, 'total': total, 'exact': exact}}}}, [found / total, -r]) AS b FROM {{excerpt_parts}} GROUP BY doc_id) USING (doc_id)""")
def excerpt_checks(t: Tables) -> DataFrame:
    """Whether each document has what an excerpt quotes, by fifteen kinds of excerpts."""
    return excerpts.with_excerpt_verdict(t.quoted, "excerpt", "text", "v").select("doc_id", "v.verdict", "v.found", "v.total", "v.mode")
