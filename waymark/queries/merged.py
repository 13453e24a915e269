"""Overlays of returned records and inputs of models, over whole tables (survey B5, B14, T31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import inputs, overlays
from waymark.queries.registry import FIXTURES, SQL_ONLY, Tables, query

_STREET = "CAST({k} % 50 AS STRING) || CASE WHEN {k} % 3 = 0 THEN '  Main St' ELSE ' main st' END"
FIXTURES.update({
    # Orders are passes over their customers; files of answers about every second and third customer, some twice.
    "returned": f"""
SELECT o_custkey AS place_id, o_orderkey AS pass_no, {_STREET.format(k="o_custkey")} AS street_address, CASE WHEN o_orderkey % 7 = 0 THEN 'Elsewhere' ELSE 'City' || CAST(o_custkey % 9 AS STRING) END AS city, CAST(94000 + o_custkey % 90 AS STRING) AS zip,
  CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'unknown' END AS is_worship, 'http://a.org/' || CAST(o_orderkey % 5 AS STRING) AS address_source_url, 'at ' || CAST(o_orderkey % 4 AS STRING) AS address_excerpt, 'Sunday ' || CAST(o_orderkey % 12 AS STRING) AS service_times, 'English' AS service_languages FROM {{orders}}""",
    "service_answers": "SELECT c_custkey - c_custkey % 3 AS place_id, c_custkey % 3 AS file_no, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Sat ' || CAST(c_custkey % 12 AS STRING) END AS service_times, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Korean' END AS service_languages FROM {customer} WHERE c_custkey % 3 < 2",
    "place_answers": """
SELECT c_custkey - c_custkey % 4 + 1 AS place_id, c_custkey % 4 AS file_no, 'fp' || CAST(c_custkey % 6 AS STRING) AS fingerprint, CASE c_custkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'unknown' WHEN 3 THEN 'maybe' END AS is_worship,
  CASE WHEN c_custkey % 3 = 0 THEN '9 Other St' WHEN c_custkey % 3 = 1 THEN '' END AS worship_street, CASE WHEN c_custkey % 2 = 0 THEN 'Othertown' END AS worship_city, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '94999' END AS worship_zip, 'http://w.org/' || CAST(c_custkey % 8 AS STRING) AS source_url, CASE WHEN c_custkey % 9 > 0 THEN 'we meet' END AS excerpt FROM {customer} WHERE c_custkey % 4 < 3""",
    "answer_checks": "SELECT place_id, file_no, CASE WHEN place_id % 11 = 0 THEN 'not_found' ELSE 'verified' END AS verdict, CASE WHEN (place_id + file_no) % 8 = 0 THEN 'other' ELSE fingerprint END AS fingerprint FROM {place_answers}",
    "asked": f"SELECT place_id, file_no, upper({_STREET.format(k='place_id')}) AS street_address, ' city' || CAST(place_id % 9 AS STRING) AS city FROM {{place_answers}} WHERE (place_id + 3 * file_no) % 10 <> 0",
    "cited": "SELECT c_custkey AS place_id, ' http://s.org/' || CAST(c_custkey % 6 AS STRING) AS address_source_url, 'http://s.org/' || CAST(c_custkey % 4 AS STRING) AS phone_source_url, '1 St' AS street_address, '94' AS zip, '555' AS phone FROM {customer}",
    "stale_sources": "SELECT c_custkey AS place_id, CASE WHEN c_custkey % 2 = 0 THEN 'address' ELSE 'phone' END AS field, 'http://s.org/' || CAST(c_custkey % 5 AS STRING) AS source_url FROM {customer} WHERE c_custkey % 3 <> 1",
})


def _asked(street: str, city: str) -> str:
    return " || '|' || ".join(f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))" for c in (street, city))


@query(f"""
WITH base AS (SELECT * FROM {{returned}} QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY pass_no DESC) = 1),
s AS (SELECT * FROM {{service_answers}} QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY file_no DESC) = 1),
w AS (SELECT a.*, {_asked("q.street_address", "q.city")} AS asked FROM {{place_answers}} a JOIN {{asked}} q USING (place_id, file_no) WHERE EXISTS (SELECT 1 FROM {{answer_checks}} c WHERE c.place_id = a.place_id AND c.file_no = a.file_no AND c.verdict = 'verified' AND c.fingerprint = a.fingerprint)
  QUALIFY row_number() OVER (PARTITION BY a.place_id ORDER BY a.file_no DESC) = 1),
j AS (SELECT b.*, s.file_no AS service_owner, s.service_times AS st, s.service_languages AS sl, w.file_no AS wf, w.asked IS NOT NULL AND w.asked <> {_asked("b.street_address", "b.city")} AS ask_again, lower(trim(w.is_worship)) AS ans, nullif(w.worship_street, '') AS ws, nullif(w.worship_city, '') AS wc, nullif(w.worship_zip, '') AS wz, coalesce(w.source_url, '') AS wu, coalesce(w.excerpt, '') AS we
  FROM base b LEFT JOIN s USING (place_id) LEFT JOIN w USING (place_id)),
k AS (SELECT *, NOT ask_again AND ws IS NOT NULL AS moved FROM j)
SELECT place_id, pass_no, CASE WHEN moved THEN ws ELSE street_address END AS street_address, CASE WHEN moved THEN coalesce(wc, city) ELSE city END AS city, CASE WHEN moved THEN coalesce(wz, zip) ELSE zip END AS zip,
  CASE WHEN NOT ask_again AND ans IN ('yes', 'no', 'unknown') THEN CASE WHEN moved AND ans = 'no' THEN 'yes' ELSE ans END ELSE is_worship END AS is_worship, CASE WHEN moved THEN wu ELSE address_source_url END AS address_source_url, CASE WHEN moved THEN we ELSE address_excerpt END AS address_excerpt,
  CASE WHEN service_owner IS NOT NULL THEN coalesce(st, '') ELSE service_times END AS service_times, CASE WHEN service_owner IS NOT NULL THEN coalesce(sl, '') ELSE service_languages END AS service_languages, service_owner, CASE WHEN moved THEN wf END AS address_owner, ask_again FROM k""")
def guarded_overlays(t: Tables) -> DataFrame:
    """Records with the answers that overlay them, while what they were asked about and proven by holds."""
    proven = overlays.proven_answers(t.place_answers, t.answer_checks, t.asked, ["place_id"])
    return overlays.overlaid(t.returned, t.service_answers, proven, ["place_id"], ["service_times", "service_languages"])


@query("""
SELECT f.place_id, CASE WHEN a.source_url IS NOT NULL THEN '' ELSE street_address END AS street_address, CASE WHEN a.source_url IS NOT NULL THEN '' ELSE zip END AS zip, CASE WHEN a.source_url IS NOT NULL THEN '' ELSE address_source_url END AS address_source_url, CASE WHEN p.source_url IS NOT NULL THEN '' ELSE phone END AS phone, CASE WHEN p.source_url IS NOT NULL THEN '' ELSE phone_source_url END AS phone_source_url
FROM {cited} f LEFT JOIN {stale_sources} a ON a.place_id = f.place_id AND a.field = 'address' AND a.source_url = trim(f.address_source_url) LEFT JOIN {stale_sources} p ON p.place_id = f.place_id AND p.field = 'phone' AND p.source_url = trim(f.phone_source_url)""")
def stale_facts_blanked(t: Tables) -> DataFrame:
    """Facts that still cite a source known to be stale become blank."""
    return overlays.without_stale(t.cited, t.stale_sources, "place_id", {"address": ["street_address", "zip", "address_source_url"], "phone": ["phone", "phone_source_url"]})


#: Turns of a conversation as pages; a budget of characters that many conversations exceed.
FIXTURES["turns"] = "SELECT conv_id, turn, role AS kind, 'conv/' || CAST(conv_id AS STRING) AS url, CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL WHEN (conv_id + turn) % 19 = 0 THEN '  ' ELSE text END AS text FROM {conversations}"
#: Equal turns of a conversation can't be told apart by their numbers alone.
_ORDER = ["turn", "kind", "text"]
SQL_ONLY["budgeted"] = """
SELECT conv_id, nth, kind, url, substr(text, 1, least(120, 300 - used)::BIGINT) AS text FROM (
  SELECT *, row_number() OVER w AS nth, coalesce(sum(least(length(text), 120)) OVER (PARTITION BY conv_id ORDER BY turn, kind, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {turns} WHERE trim(coalesce(text, '')) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, kind, text))
WHERE used < 300"""


@query("SELECT conv_id, string_agg('=== PAGE ' || nth || ' (' || coalesce(kind, '') || ') ' || url || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY nth) AS input FROM {budgeted} GROUP BY conv_id")
def model_inputs(t: Tables) -> DataFrame:
    """Pages within a budget of characters for each page and all of them."""
    return inputs.model_input(t.turns, "conv_id", _ORDER, 120, 300)


@query("""
SELECT conv_id, CASE WHEN length(x) > 400 THEN substr(x, 1, 400) || chr(10) || chr(10) || '[...truncated]' ELSE x END AS input FROM (
  SELECT conv_id, string_agg('# ' || coalesce(kind, '') || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn, kind, '# ' || coalesce(kind, '') || chr(10) || trim(text) || chr(10) || chr(10)) AS x FROM {turns} WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id)""")
def headed_inputs(t: Tables) -> DataFrame:
    """Pages one after another under their kinds, cut with a mark."""
    return inputs.headed_text(t.turns, "conv_id", _ORDER, 400)
