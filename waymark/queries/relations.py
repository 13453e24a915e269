"""Queries for the derived relations: each model of waymark.plans on stand-in inputs, and its SQL; and all assertions at once."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.models import KNOWN_BATCHES, KNOWN_PASSES, KNOWN_TASKS, MODELS, PACKAGE, Build, assertions
from waymark.queries.registry import FIXTURES, SQL_ONLY, Tables, query

AS_OF = "1998-06-01"

_PER_PLACE = "(SELECT o_custkey AS k, max(o_orderdate) AS d, count(*) AS n FROM {orders} GROUP BY o_custkey)"
_TYPES = "'own_site' WHEN 1 THEN 'denomination' WHEN 2 THEN 'fb_page' ELSE ''"

FIXTURES.update({
    "manifest": f"SELECT k AS place_id, CASE k % 4 WHEN 0 THEN 'A_calibration' WHEN 1 THEN 'B_main' WHEN 2 THEN 'c' ELSE 'd' END AS batch FROM {_PER_PLACE} o",
    "results": f"""
SELECT k AS place_id, CASE k % 4 WHEN 0 THEN 'A_calibration' WHEN 1 THEN 'B_main' WHEN 2 THEN 'c' ELSE 'd' END AS batch, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'WP0012' ELSE 'pass 2' END AS last_pass, k % 31 = 0 AS personal_phone_withheld, CAST(d AS DATE) AS checked_at,
  CASE k % 10 WHEN 0 THEN 'business' WHEN 1 THEN 'religious_house' WHEN 2 THEN 'unknown' WHEN 3 THEN 'non_christian' ELSE 'congregation' END AS entity_type,
  CASE WHEN k % 23 = 0 THEN k + 1 END AS duplicate_of_place_id, CASE n % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'unresolved' ELSE 'active' END AS status,
  CASE k % 4 WHEN 0 THEN {_TYPES} END AS status_source_type, 'http://s/' || CAST(k AS STRING) AS status_source_url, CASE WHEN k % 5 = 0 THEN '' ELSE 'Place ' || CAST(k AS STRING) END AS current_name,
  CASE WHEN k % 2 = 0 THEN 'http://p' || CAST(k AS STRING) || '.org' ELSE '' END AS official_url, CASE n % 4 WHEN 0 THEN 'name_only' WHEN 1 THEN '' ELSE 'address' END AS url_evidence,
  CASE WHEN k % 3 = 1 THEN 'http://facebook.com/p' || CAST(k AS STRING) END AS facebook_page_url, CASE WHEN k % 7 <> 0 THEN 'linked' ELSE '' END AS fb_page_evidence,
  CASE WHEN k % 5 <> 1 THEN CAST(d AS DATE) END AS fb_last_post_date, CASE k % 8 WHEN 0 THEN '' ELSE CAST(k % 90 AS STRING) || ' Main St' END AS street_address,
  CASE WHEN k % 9 = 0 THEN '' ELSE 'Town' || CAST(k % 6 AS STRING) END AS city, CAST(90000 + k % 50 AS STRING) AS zip, 'http://a/' || CAST(k AS STRING) AS address_source_url, CASE (k + 1) % 4 WHEN 0 THEN {_TYPES} END AS address_source_type,
  CASE WHEN n % 5 <> 0 THEN 'yes' ELSE '' END AS address_is_worship_location, CASE k % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'ok' ELSE '' END AS pin_check,
  CASE WHEN k % 3 = 0 THEN '(555) 010-' || CAST(1000 + k % 9000 AS STRING) END AS phone, 'http://t/' || CAST(k AS STRING) AS phone_source_url, CASE n % 4 WHEN 0 THEN {_TYPES} END AS phone_source_type,
  CASE WHEN k % 4 = 1 THEN 'Sun 10am' ELSE '' END AS service_times, CASE k % 8 WHEN 1 THEN 'Mandarin; English' WHEN 5 THEN ' Korean;' END AS service_languages, 'http://v/' || CAST(k AS STRING) AS service_source_url, CASE (n + k) % 4 WHEN 0 THEN {_TYPES} END AS service_source_type,
  CASE WHEN k % 6 = 1 THEN 'Kids club' END AS kids_program, 'http://k/' || CAST(k AS STRING) AS kids_source_url, CASE (n + 1) % 4 WHEN 0 THEN {_TYPES} END AS kids_source_type
FROM {_PER_PLACE} o""",
    "candidates": f"""
SELECT 'C-' || CAST(s_suppkey AS STRING) AS candidate_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Place ' || CAST(s_suppkey AS STRING) ELSE s_name END AS candidate_name, CASE s_suppkey % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'WP0003' WHEN 2 THEN 'WP3' ELSE 'Z' END AS task, s_suppkey % 9 = 0 AS personal_phone_withheld,
  CASE WHEN s_suppkey % 13 = 0 THEN s_suppkey END AS duplicate_of_place_id, CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey END AS possible_match_place_id, CASE WHEN s_suppkey % 17 = 0 THEN 'C-1' ELSE '' END AS possible_match_candidate_id,
  'Stated' AS denomination_stated, CASE WHEN s_suppkey % 7 = 0 THEN 'closed' ELSE 'active' END AS status, CASE s_suppkey % 2 WHEN 0 THEN {_TYPES} END AS status_source_type, 'http://cs' AS status_source_url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'http://c.org' ELSE '' END AS official_url, 'address' AS url_evidence, CASE WHEN s_suppkey % 3 = 1 THEN 'http://facebook.com/c' END AS facebook_page_url, 'linked' AS fb_page_evidence,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST('1998-01-05' AS DATE) END AS fb_last_post_date, CAST(s_suppkey % 90 AS STRING) || ' Main St' AS street_address, 'Town' || CAST(s_suppkey % 6 AS STRING) AS city,
  CAST(90000 + s_suppkey % 50 AS STRING) AS zip, 'http://ca' AS address_source_url, CASE s_suppkey % 3 WHEN 0 THEN {_TYPES} END AS address_source_type, CASE WHEN s_suppkey % 5 <> 0 THEN 'yes' ELSE '' END AS address_is_worship_location,
  CASE WHEN s_suppkey % 2 = 1 THEN '(555) 020-' || CAST(1000 + s_suppkey AS STRING) ELSE '' END AS phone, 'http://cp' AS phone_source_url, 'own_site' AS phone_source_type, CASE WHEN s_suppkey % 4 = 3 THEN 'Sat 6pm' END AS service_times,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Spanish ;English' END AS service_languages, 'http://cv' AS service_source_url, 'own_site' AS service_source_type, CASE WHEN s_suppkey % 6 = 3 THEN 'Kids' END AS kids_program,
  'http://ck' AS kids_source_url, 'denomination' AS kids_source_type, CAST('1998-02-03' AS DATE) AS checked_at
FROM {{supplier}}""",
    "source_checks": """
SELECT 'place' AS subject_type, CAST(place_id AS STRING) AS subject_id, g AS fact_group, CASE WHEN (place_id + i) % 5 = 0 THEN 'failed' ELSE 'verified' END AS verdict, checked_at
FROM {results} CROSS JOIN (VALUES ('status', 0), ('address', 1), ('phone', 2), ('service', 3), ('kids', 4)) AS f(g, i)
UNION ALL SELECT 'candidate', candidate_id, g, CASE WHEN (length(candidate_id) + i) % 5 = 0 THEN 'failed' ELSE 'verified' END, checked_at
FROM {candidates} CROSS JOIN (VALUES ('status', 0), ('address', 1), ('phone', 3), ('service', 4)) AS f(g, i)""",
    "geocodes": """
SELECT 'place' AS subject_type, CAST(place_id AS STRING) AS subject_id, CASE WHEN place_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(place_id % 64 AS DOUBLE) / 64 + 30 AS latitude, CAST(place_id % 128 AS DOUBLE) / 64 - 120 AS longitude,
  'Exact' AS match_type, 'MATCH ' || CAST(place_id % 40 AS STRING) AS matched_address, CAST(place_id % 200 AS DOUBLE) AS distance_from_current_pin_m,
  CASE WHEN place_id % 6 = 0 THEN 'elsewhere' ELSE street_address END AS geocoded_street, city AS geocoded_city, zip AS geocoded_zip FROM {results}
UNION ALL SELECT 'candidate', candidate_id, 'ok', CAST(length(candidate_name) AS DOUBLE) + 30, CAST(-120 AS DOUBLE), 'Exact', CASE WHEN length(candidate_id) = 4 THEN 'MATCH ' || substring(candidate_id, 3, 1) ELSE '' END, CAST(NULL AS DOUBLE), street_address, city, zip FROM {candidates}""",
    "tradition_scope": "SELECT DISTINCT lower(c_mktsegment) AS denomination_key, CASE length(c_mktsegment) WHEN 10 THEN 'in_scope_labeled' WHEN 9 THEN 'pending' ELSE 'out_of_scope' END AS scope_status, 'The ' || c_mktsegment AS display_tradition FROM {customer}",
    "fact_holds": "SELECT c_custkey AS place_id, CASE c_custkey % 3 WHEN 0 THEN 'street_address' WHEN 1 THEN 'service_times' ELSE 'other' END AS field FROM {customer} WHERE c_acctbal < 0",
    "quality_reviews": "SELECT o_custkey AS place_id, CASE o_orderkey % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'address' ELSE 'pin' END AS field, CASE o_orderkey % 7 WHEN 0 THEN 'disagree' WHEN 1 THEN 'definition_disagreement' WHEN 2 THEN 'needs_review' ELSE 'agree' END AS verdict FROM {orders}",
    "snapshot_meta": "SELECT 'local' AS snapshot_source, CAST('1998-05-30' AS DATE) AS snapshot_taken_at",
})

_BLANKED = "status_source_type status_source_url official_url url_evidence facebook_page_url fb_page_evidence street_address city zip address_source_url address_source_type address_is_worship_location phone phone_source_url phone_source_type service_times service_languages service_source_url service_source_type kids_program kids_source_url kids_source_type".split()


def _blanked(*more: str) -> str:
    return ", ".join(f"nullif({c}, '') AS {c}" for c in [*_BLANKED, *more])


def _key(street: str, city: str, postcode: str = "NULL") -> str:
    return f"lower(regexp_replace(trim(coalesce({street}, '') || '|' || coalesce({city}, '') || '|' || coalesce({postcode}, ''), ' '), '\\s+', ' ', 'g'))"


def _name(column: str) -> str:
    return f"lower(regexp_replace({column}, '[^\\p{{{{L}}}}\\p{{{{N}}}}]', '', 'g'))"


#: A fact that its site or tradition states and that was found there, or that a fresh page of an active place states.
def _fact(value: str, kind: str) -> str:
    return f"({value} IS NOT NULL AND (({kind}_source_type IN ('own_site', 'denomination') AND {kind}_ok) OR ({kind}_source_type = 'fb_page' AND verified_active AND fresh)))"


_OK = ", ".join(f"coalesce({f}_ok, false) AS {f}_ok" for f in ("status", "address", "phone", "service", "kids"))
_FLAGS = ", ".join(f"bool_or(fact_group = '{f}' AND is_verified) AS {f}_ok" for f in ("status", "address", "phone", "service", "kids"))
_ACTIVE = f"coalesce(fb_last_post_date >= DATE '{AS_OF}' - 365, false) AS fresh, coalesce(status = 'active' AND ((status_source_type IN ('own_site', 'denomination') AND status_ok) OR (status_source_type = 'fb_page' AND coalesce(fb_last_post_date >= DATE '{AS_OF}' - 365, false))), false) AS verified_active"
_SHOWN = f"{_fact('street_address', 'address')} AS address_displayable, {_fact('phone', 'phone')} AS phone_displayable, {_fact('service_times', 'service')} AS service_displayable, {_fact('kids_program', 'kids')} AS kids_displayable, official_url IS NOT NULL AND coalesce(url_evidence, 'name_only') <> 'name_only' AS website_verified, facebook_page_url IS NOT NULL AND fb_page_evidence IS NOT NULL AS fb_page_linkable"
_REACH = "(website_verified OR (fb_page_linkable AND fresh) OR phone_displayable)"

SQL_ONLY.update({
    "stg_places": """SELECT place_id, nullif(trim(name, ' '), '') AS listed_name, nullif(trim(address, ' '), '') AS street_text, coalesce(regexp_matches(address, '^\\s*[0-9]'), false) AS has_house_number, coalesce(has_google_address, false) AS has_google_address,
  nullif(trim(city, ' '), '') AS city, nullif(trim(state, ' '), '') AS state, nullif(trim(zip_code, ' '), '') AS zip, latitude, longitude,
  coalesce(latitude BETWEEN -15 AND 72 AND (longitude BETWEEN -180 AND -64 OR longitude BETWEEN 144 AND 180) AND NOT (latitude = 0 AND longitude = 0), false) AS coords_ok,
  nullif(trim(website, ' '), '') AS website, nullif(trim(phone, ' '), '') AS phone, coalesce(source, 'unknown') AS source, external_id, nullif(trim(denomination, ' '), '') AS denomination FROM {places} WHERE source IS DISTINCT FROM 'found'""",
    "stg_published": "SELECT place_id, external_id AS candidate_id, nullif(trim(name, ' '), '') AS published_name, nullif(trim(address, ' '), '') AS published_street, nullif(trim(city, ' '), '') AS city, latitude, longitude FROM {places} WHERE source = 'found'",
    "stg_results": f"SELECT place_id, batch, last_pass, personal_phone_withheld, checked_at, entity_type, duplicate_of_place_id, status, fb_last_post_date, {_blanked('current_name', 'pin_check')} FROM {{results}}",
    "stg_candidates": f"SELECT candidate_id, candidate_name, task, personal_phone_withheld, duplicate_of_place_id, possible_match_place_id, status, fb_last_post_date, checked_at, {_blanked('possible_match_candidate_id', 'denomination_stated')}, coalesce(CAST(duplicate_of_place_id AS VARCHAR), CAST(possible_match_place_id AS VARCHAR), nullif(possible_match_candidate_id, '')) IS NULL AS is_new_place FROM {{candidates}}",
    "stg_checks": "SELECT subject_type, subject_id, fact_group, verdict, verdict = 'verified' AS is_verified, checked_at FROM {source_checks}",
    "stg_geocodes": "SELECT subject_type, subject_id, status AS geocode_status, latitude, longitude, distance_from_current_pin_m, nullif(match_type, '') AS match_type, nullif(matched_address, '') AS matched_address, nullif(geocoded_street, '') AS geocoded_street, nullif(geocoded_city, '') AS geocoded_city, nullif(geocoded_zip, '') AS geocoded_zip FROM {geocodes}",
    "int_scope": """SELECT place_id, display_tradition, split_part(v, '/', 1) AS scope_status, split_part(v, '/', 2) AS scope_basis FROM (
  SELECT p.place_id, t.display_tradition, CASE WHEN r.duplicate_of_place_id IS NOT NULL THEN 'duplicate/research' WHEN r.entity_type = 'non_christian' THEN 'out_of_scope/research' WHEN r.entity_type IN ('religious_house', 'business') THEN 'not_a_congregation/research'
    WHEN r.entity_type = 'unknown' THEN 'pending/research' WHEN r.entity_type = 'congregation' AND t.scope_status = 'pending' THEN 'in_scope/research' WHEN t.scope_status IS NOT NULL THEN t.scope_status || '/denomination'
    WHEN regexp_matches(p.listed_name, '(convent|monastery|abbey|motherhouse|^sisters of)', 'i') THEN 'not_a_congregation/name_pattern' WHEN r.entity_type = 'congregation' THEN 'in_scope/research' ELSE 'in_scope/default' END AS v
  FROM {stg_places} p LEFT JOIN {tradition_scope} t ON lower(p.denomination) = t.denomination_key LEFT JOIN {stg_results} r ON r.place_id = p.place_id)""",
    "int_clusters": "SELECT place_id, n AS records_at_point FROM (SELECT place_id, count(*) OVER (PARTITION BY round(latitude, 4), round(longitude, 4)) AS n FROM {stg_places} WHERE latitude IS NOT NULL AND longitude IS NOT NULL) WHERE n > 3",
    "int_geocodes": f"""SELECT subject_type, subject_id, geocode_status, latitude, longitude, matched_address, distance_from_current_pin_m, street_address AS current_street, same AS address_unchanged, geocode_status = 'ok' AND latitude IS NOT NULL AND longitude IS NOT NULL AND same AS pin_usable
  FROM (SELECT g.*, s.street_address, coalesce({_key('g.geocoded_street', 'g.geocoded_city', 'g.geocoded_zip')} = {_key('s.street_address', 's.city', 's.zip')} AND s.found, false) AS same FROM {{stg_geocodes}} g LEFT JOIN (
    SELECT 'candidate' AS subject_type, candidate_id AS subject_id, street_address, city, zip, true AS found FROM {{stg_candidates}} UNION ALL
    SELECT 'place', CAST(r.place_id AS VARCHAR), r.street_address, coalesce(r.city, p.city), r.zip, true FROM {{stg_results}} r JOIN {{stg_places}} p USING (place_id)) s USING (subject_type, subject_id))""",
    "place_flags": f"""SELECT *, scope_status IN ('in_scope', 'in_scope_labeled') AS is_in_scope FROM (SELECT *, {_SHOWN} FROM (SELECT *, {_ACTIVE} FROM (
    SELECT p.place_id, p.listed_name, p.denomination, p.source, p.external_id, p.city, p.state, p.latitude, p.longitude, p.coords_ok, p.street_text, p.has_house_number, p.has_google_address, s.scope_status, s.scope_basis, s.display_tradition,
      (p.has_house_number OR p.has_google_address) AND p.city IS NOT NULL AND p.state IS NOT NULL AS has_routable_directory_address, k.place_id IS NOT NULL AS in_repeated_cluster, r.place_id IS NOT NULL AS researched, coalesce(h.hold_address, false) AS hold_address, coalesce(h.hold_service, false) AS hold_service,
      r.batch, r.last_pass, r.checked_at, r.status, r.status_source_type, r.current_name, r.official_url, r.url_evidence, r.facebook_page_url, r.fb_page_evidence, r.fb_last_post_date, r.street_address, r.city AS result_city, r.zip AS result_zip,
      r.address_source_url, r.address_source_type, r.address_is_worship_location, r.pin_check, r.phone, r.phone_source_url, r.phone_source_type, r.service_times, r.service_languages, r.service_source_url, r.service_source_type, r.kids_program, r.kids_source_url, r.kids_source_type,
      {_OK}, coalesce(g.pin_usable, false) AS proposed_pin_usable, CASE WHEN g.pin_usable THEN g.latitude END AS proposed_latitude, CASE WHEN g.pin_usable THEN g.longitude END AS proposed_longitude, CASE WHEN g.pin_usable THEN g.distance_from_current_pin_m END AS proposed_pin_moves_m
    FROM {{stg_places}} p JOIN {{int_scope}} s USING (place_id) LEFT JOIN {{int_clusters}} k USING (place_id) LEFT JOIN {{stg_results}} r USING (place_id)
    LEFT JOIN (SELECT place_id, bool_or(field = 'street_address') AS hold_address, bool_or(field = 'service_times') AS hold_service FROM {{fact_holds}} GROUP BY place_id) h USING (place_id)
    LEFT JOIN (SELECT TRY_CAST(subject_id AS BIGINT) AS place_id, {_FLAGS} FROM {{stg_checks}} WHERE subject_type = 'place' GROUP BY 1) c USING (place_id)
    LEFT JOIN (SELECT TRY_CAST(subject_id AS BIGINT) AS place_id, * EXCLUDE (subject_id) FROM {{int_geocodes}} WHERE subject_type = 'place') g USING (place_id))))""",
    "place_ready": f"""SELECT * REPLACE (address_displayable AND NOT hold_address AS address_displayable, service_displayable AND NOT hold_service AS service_displayable),
  is_in_scope AND verified_active AND (address_displayable AND NOT hold_address) AND coalesce(address_is_worship_location, '') = 'yes' AND coords_ok AND coalesce(pin_check, 'unknown') <> 'off' AND {_REACH} AS visit_ready FROM {{place_flags}}""",
    "candidate_ready": f"""SELECT *, profile_ready AND pin_usable AS map_ready, NOT pin_usable AS needs_geocode FROM (SELECT *, is_new_place AND verified_active AND address_displayable AND coalesce(address_is_worship_location, '') = 'yes' AND {_REACH} AS profile_ready FROM (SELECT *, {_SHOWN} FROM (SELECT *, {_ACTIVE} FROM (
    SELECT c.*, {_OK}, g.geocode_status, coalesce(g.pin_usable, false) AS pin_usable, CASE WHEN g.pin_usable THEN g.latitude END AS latitude, CASE WHEN g.pin_usable THEN g.longitude END AS longitude FROM {{stg_candidates}} c
    LEFT JOIN (SELECT subject_id AS candidate_id, {_FLAGS} FROM {{stg_checks}} WHERE subject_type = 'candidate' GROUP BY 1) k USING (candidate_id) LEFT JOIN (SELECT * FROM {{int_geocodes}} WHERE subject_type = 'candidate') g ON g.subject_id = c.candidate_id))))""",
    "dim_place": """SELECT place_id, coalesce(current_name, listed_name) AS display_name, listed_name, denomination, display_tradition, scope_status, scope_basis, source, external_id, coalesce(result_city, city) AS city, state, latitude, longitude,
  coalesce(batch IN ('A_calibration', 'B_main'), false) AS in_pilot, batch, status, verified_active, CASE WHEN address_displayable THEN street_address END AS display_street_address, CASE WHEN address_displayable THEN result_zip END AS display_zip, CASE WHEN address_displayable THEN address_source_type END AS address_source_type,
  CASE WHEN phone_displayable THEN phone END AS display_phone, CASE WHEN service_displayable THEN service_times END AS display_service_times, service_languages, CASE WHEN kids_displayable THEN kids_program END AS display_kids_program, CASE WHEN website_verified THEN official_url END AS verified_website,
  CASE WHEN fb_page_linkable THEN facebook_page_url END AS facebook_page_url, fb_last_post_date, has_routable_directory_address, coords_ok, in_repeated_cluster, address_displayable, phone_displayable, service_displayable, kids_displayable, visit_ready, proposed_pin_usable, proposed_latitude, proposed_longitude, proposed_pin_moves_m, checked_at, last_pass FROM {place_ready}""",
    "mart_new_places": """SELECT candidate_id, candidate_name, city, CASE WHEN address_displayable THEN street_address END AS display_street_address, CASE WHEN address_displayable THEN zip END AS display_zip, CASE WHEN website_verified THEN official_url END AS verified_website,
  CASE WHEN fb_page_linkable THEN facebook_page_url END AS facebook_page_url, CASE WHEN phone_displayable THEN phone END AS display_phone, CASE WHEN service_displayable THEN service_times END AS display_service_times, service_languages,
  CASE WHEN kids_displayable THEN kids_program END AS display_kids_program, status, address_displayable, latitude, longitude, profile_ready, map_ready, needs_geocode FROM {candidate_ready} WHERE is_new_place""",
    "mart_coverage": f"""SELECT geo_scope, source, count(*) AS records, count(*) FILTER (scope_status = 'in_scope_labeled') AS in_scope_labeled, count(*) FILTER (NOT is_in_scope) AS hidden_by_scope, count(*) FILTER (researched) AS researched, count(*) FILTER (is_in_scope) AS in_scope,
  count(street_text) AS street_text, count(*) FILTER (has_house_number) AS house_numbered, count(*) FILTER (has_routable_directory_address) AS routable_directory_address, count(*) FILTER (coords_ok) AS coords_ok, count(*) FILTER (in_repeated_cluster) AS in_repeated_cluster,
  count(*) FILTER (verified_active) AS verified_active, count(*) FILTER (address_displayable) AS verified_address, count(*) FILTER (kids_displayable) AS kids_program_shown, count(*) FILTER (visit_ready) AS visit_ready, 'local' AS snapshot_source, DATE '1998-05-30' AS snapshot_taken_at, DATE '{AS_OF}' AS as_of_date
  FROM (SELECT 'national' AS geo_scope, * FROM {{place_ready}} UNION ALL BY NAME SELECT CASE WHEN m.batch IN ('A_calibration', 'B_main') THEN 'pilot' ELSE 'batch_' || m.batch END AS geo_scope, r.* FROM {{place_ready}} r JOIN {{manifest}} m USING (place_id)) GROUP BY ALL""",
    "mart_language_supply": """SELECT language, city, origin, count(*) AS places, count(*) FILTER (verified_active) AS active, count(*) FILTER (service_displayable) AS with_shown_service_times, count(*) FILTER (kids_displayable) AS with_shown_kids_program, count(*) FILTER (ready) AS ready FROM (
  SELECT 'directory' AS origin, coalesce(result_city, city) AS city, verified_active, service_displayable, kids_displayable, visit_ready AS ready, trim(unnest(string_split(service_languages, ';')), ' ') AS language FROM {place_ready} WHERE is_in_scope UNION ALL
  SELECT 'new', city, verified_active, service_displayable, kids_displayable, profile_ready, trim(unnest(string_split(service_languages, ';')), ' ') FROM {candidate_ready} WHERE is_new_place) WHERE language <> '' GROUP BY ALL""",
    "mart_scorecard": """SELECT coalesce(last_pass, 'all') AS last_pass, count(*) AS rows, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status IN ('closed', 'merged')) AS closed_or_merged, count(*) FILTER (NOT is_in_scope) AS hidden_by_scope,
  count(street_address) AS address_found, count(*) FILTER (address_displayable) AS address_displayable, count(*) FILTER (street_address IS NOT NULL AND NOT address_displayable) AS address_needs_review, count(*) FILTER (street_address IS NOT NULL AND address_source_type IN ('own_site', 'denomination') AND NOT address_ok) AS address_failed_recheck,
  count(*) FILTER (phone_displayable) AS phone_displayable, count(*) FILTER (service_displayable) AS service_displayable, count(kids_program) AS kids_found, count(*) FILTER (kids_displayable) AS kids_displayable, count(*) FILTER (fb_page_linkable) AS fb_page_linkable,
  count(*) FILTER (address_displayable AND address_source_type = 'fb_page') + count(*) FILTER (phone_displayable AND phone_source_type = 'fb_page') + count(*) FILTER (service_displayable AND service_source_type = 'fb_page') AS fb_only_facts_shown, count(*) FILTER (visit_ready) AS visit_ready
  FROM {place_ready} WHERE researched GROUP BY ROLLUP (last_pass)""",
    "mart_directory_matches": f"""WITH n AS (SELECT candidate_id, {_name('candidate_name')} AS nk, CASE WHEN display_street_address IS NOT NULL THEN {_key('display_street_address', 'city')} END AS a, g.matched_address AS m FROM {{mart_new_places}} LEFT JOIN (SELECT subject_id AS candidate_id, matched_address FROM {{int_geocodes}} WHERE pin_usable AND subject_type = 'candidate') g USING (candidate_id)),
  d AS (SELECT DISTINCT place_id, CAST(NULL AS VARCHAR) AS pc, unnest([{_name('display_name')}, {_name('listed_name')}]) AS nk, CASE WHEN display_street_address IS NOT NULL THEN {_key('display_street_address', 'd.city')} END AS a, CASE WHEN street_text IS NOT NULL THEN {_key('street_text', 'p.city')} END AS raw, g.matched_address AS m
    FROM {{dim_place}} d JOIN (SELECT place_id, street_text, city FROM {{stg_places}}) p USING (place_id) LEFT JOIN (SELECT TRY_CAST(subject_id AS BIGINT) AS place_id, matched_address FROM {{int_geocodes}} WHERE pin_usable AND subject_type = 'place') g USING (place_id)
    UNION ALL SELECT place_id, candidate_id, {_name('published_name')}, CASE WHEN published_street IS NOT NULL THEN {_key('published_street', 'city')} END, NULL, g.matched_address FROM {{stg_published}} LEFT JOIN (SELECT subject_id AS candidate_id, matched_address FROM {{int_geocodes}} WHERE pin_usable AND subject_type = 'candidate') g USING (candidate_id))
  SELECT candidate_id, place_id, CASE WHEN pc IS NOT NULL THEN 'published_place' WHEN n.a = d.a THEN 'verified_address' WHEN n.a = d.raw THEN 'directory_address' ELSE 'census_match' END AS matched_on FROM n JOIN d USING (nk) WHERE (n.a = d.a OR n.a = d.raw OR n.m = d.m) AND pc IS DISTINCT FROM candidate_id""",
    "mart_publish_places": """SELECT * FROM (SELECT place_id, nullif(scope_status, 'in_scope') AS scope_status, display_tradition, CASE WHEN i THEN sa END AS address, CASE WHEN i AND address_displayable THEN result_zip END AS zip_code, CASE WHEN i AND sa IS NOT NULL THEN address_source_url END AS address_source_url, CASE WHEN i AND sa IS NOT NULL THEN address_source_type END AS address_source_type,
  CASE WHEN i THEN ph END AS phone, CASE WHEN i AND ph IS NOT NULL THEN phone_source_url END AS phone_source_url, CASE WHEN i AND ph IS NOT NULL THEN phone_source_type END AS phone_source_type, CASE WHEN i THEN sv END AS service_times, CASE WHEN i AND sv IS NOT NULL THEN service_languages END AS service_languages, CASE WHEN i AND sv IS NOT NULL THEN service_source_url END AS service_source_url,
  CASE WHEN i AND sv IS NOT NULL THEN service_source_type END AS service_source_type, CASE WHEN i THEN kd END AS kids_program, CASE WHEN i AND kd IS NOT NULL THEN kids_source_url END AS kids_source_url, CASE WHEN i AND kd IS NOT NULL THEN kids_source_type END AS kids_source_type, CASE WHEN i AND website_verified THEN official_url END AS website,
  CASE WHEN i AND fb_page_linkable THEN facebook_page_url END AS facebook_url, CASE WHEN i AND mv THEN proposed_latitude END AS latitude, CASE WHEN i AND mv THEN proposed_longitude END AS longitude, checked_at
  FROM (SELECT *, is_in_scope AS i, CASE WHEN address_displayable THEN street_address END AS sa, CASE WHEN phone_displayable THEN phone END AS ph, CASE WHEN service_displayable THEN service_times END AS sv, CASE WHEN kids_displayable THEN kids_program END AS kd, coalesce(pin_check = 'off' AND proposed_pin_usable AND proposed_pin_moves_m > 50, false) AS mv FROM {place_ready}))
  WHERE coalesce(scope_status, address, phone, service_times, kids_program, website, facebook_url) IS NOT NULL OR latitude IS NOT NULL""",
    "mart_publish_new": """SELECT candidate_id AS external_id, candidate_name AS name, denomination_stated AS denomination, n.display_street_address AS address, n.city, 'CA' AS state, n.display_zip AS zip_code, n.latitude, n.longitude, c.address_source_url, c.address_source_type, n.display_phone AS phone,
  CASE WHEN display_phone IS NOT NULL THEN phone_source_url END AS phone_source_url, CASE WHEN display_phone IS NOT NULL THEN phone_source_type END AS phone_source_type, display_service_times AS service_times, CASE WHEN display_service_times IS NOT NULL THEN n.service_languages END AS service_languages, CASE WHEN display_service_times IS NOT NULL THEN service_source_url END AS service_source_url,
  CASE WHEN display_service_times IS NOT NULL THEN service_source_type END AS service_source_type, display_kids_program AS kids_program, CASE WHEN display_kids_program IS NOT NULL THEN kids_source_url END AS kids_source_url, CASE WHEN display_kids_program IS NOT NULL THEN kids_source_type END AS kids_source_type, verified_website AS website, n.facebook_page_url AS facebook_url, status_source_url, status_source_type, c.checked_at
  FROM {mart_new_places} n JOIN (SELECT candidate_id, denomination_stated, address_source_url, address_source_type, phone_source_url, phone_source_type, service_source_url, service_source_type, kids_source_url, kids_source_type, status_source_url, status_source_type, checked_at FROM {stg_candidates}) c USING (candidate_id) WHERE map_ready""",
    "mart_published_standing": """SELECT p.place_id, candidate_id, published_name, c.candidate_id IS NOT NULL AS candidate_found, coalesce(is_new_place, false) AS is_new_place, coalesce(map_ready, false) AS map_ready,
  CASE WHEN c.candidate_id IS NULL THEN 'unknown_candidate' WHEN NOT is_new_place THEN 'no_longer_new' WHEN NOT map_ready THEN 'no_longer_map_ready' ELSE 'current' END AS publication_status FROM {stg_published} p LEFT JOIN {candidate_ready} c USING (candidate_id)""",
    "mart_quality_audit": """SELECT coalesce(field, 'all') AS field, count(*) AS reviewed, count(*) FILTER (verdict = 'agree') AS agree, count(*) FILTER (verdict = 'disagree') AS disagree, count(*) FILTER (verdict = 'definition_disagreement') AS definition_disagreement, count(*) FILTER (verdict = 'needs_review') AS needs_review,
  round(count(*) FILTER (verdict = 'agree') / count(*), 3) AS agreement_rate, count(DISTINCT place_id) AS places FROM {quality_reviews} GROUP BY ROLLUP (field)""",
})

_PLACE_READY = "place_id is_in_scope in_repeated_cluster hold_address hold_service address_displayable phone_displayable service_displayable kids_displayable website_verified fb_page_linkable verified_active proposed_pin_usable proposed_pin_moves_m coords_ok has_routable_directory_address visit_ready".split()
_CANDIDATE_READY = "candidate_id is_new_place verified_active address_displayable phone_displayable service_displayable kids_displayable website_verified fb_page_linkable pin_usable latitude longitude geocode_status profile_ready map_ready needs_geocode".split()
#: Relations whose flags are compared, where the others are compared whole.
_COLUMNS = {"int_place_readiness": ("place_ready", _PLACE_READY), "int_candidate_readiness": ("candidate_ready", _CANDIDATE_READY)}
_INPUTS = ("places", "snapshot_meta", "manifest", "results", "candidates", "source_checks", "geocodes", "quality_reviews", "fact_holds", "tradition_scope")


def build(t: Tables) -> Build:
    return Build({name: getattr(t, name) for name in _INPUTS}, date.fromisoformat(AS_OF))


def _register(name: str) -> None:
    of, columns = _COLUMNS.get(name, (name, None))

    def relation(t: Tables) -> DataFrame:
        out = build(t)[name]
        return out.select(*columns) if columns else out

    relation.__name__ = f"rel_{name}"
    relation.__doc__ = MODELS[name].__doc__
    query(f"SELECT {', '.join(columns) if columns else '*'} FROM {{{of}}}")(relation)


for _model in MODELS:
    _register(_model)

#: Rows that break assertions, by relation: which rows, and what they get; a relation without values loses these rows.
PLANTED: dict[str, tuple[str, dict[str, str]]] = {
    "int_place_readiness": ("place_id % 40 = 1", {"visit_ready": "true", "is_in_scope": "false", "address_is_worship_location": "NULL", "hold_address": "true", "address_displayable": "true", "address_source_type": "'fb_page'", "fb_page_fresh": "false", "phone_displayable": "true", "phone_source_type": "'own_site'", "phone_source_verified": "false", "has_routable_directory_address": "true", "has_house_number": "false", "has_google_address": "false"}),
    "int_candidate_readiness": ("candidate_id LIKE '%7'", {"is_new_place": "true", "duplicate_of_place_id": "1", "map_ready": "true", "pin_usable": "false", "kids_displayable": "true", "kids_source_type": "'own_site'", "kids_source_verified": "false", "phone_displayable": "true", "phone_source_type": "'fb_page'", "verified_active": "false"}),
    "mart_publish_places": ("place_id % 40 = 1", {"website": "'http://FACEBOOK.com/x'", "phone": "'5'", "phone_source_url": "NULL", "kids_program": "'x'", "kids_source_url": "NULL"}),
    "mart_publish_new": ("true", {"service_times": "'x'", "service_source_url": "NULL"}),
    "int_geocodes": ("subject_id LIKE '%7'", {"pin_usable": "true", "latitude": "89.5"}),
    "stg_places": ("place_id % 40 = 1", {"source": "'found'"}),
    "stg_geocodes": ("subject_id LIKE '%7'", {"geocode_status": "'ok'", "latitude": "31.5", "longitude": "-100.5"}),
    "stg_results": ("place_id % 40 = 1", {"batch": "'odd'", "address_source_url": "NULL", "street_address": "'x'", "personal_phone_withheld": "true", "phone": "'5'"}),
    "stg_candidates": ("candidate_id LIKE '%7'", {"personal_phone_withheld": "true", "phone": "'5'", "task": "'WP12'"}),
    "dim_place": ("place_id % 40 = 2", {}),
    "results": ("place_id % 40 = 3", {}),
}
#: Relations and columns that the SQL has under other names.
_IN_SQL = {"int_place_readiness": "place_ready", "int_candidate_readiness": "candidate_ready"}


def _in_sql(column: str) -> str:
    return "fresh" if column == "fb_page_fresh" else column.replace("_source_verified", "_ok")


for _name_, (_rows, _values) in PLANTED.items():
    _of = _IN_SQL.get(_name_, _name_)
    SQL_ONLY[f"planted_{_of}"] = (
        f"SELECT * REPLACE ({', '.join(f'CASE WHEN {_rows} THEN {v} ELSE {_in_sql(c)} END AS {_in_sql(c)}' for c, v in _values.items())}) FROM {{{_of}}}" if _values else f"SELECT * FROM {{{_of}}} WHERE NOT ({_rows})"
    )


def _counts(prefix: str) -> str:
    """SQL for every assertion's number of rows, over the relations or over those with planted rows."""
    at = {n: f"{{{prefix}{n}}}" for n in ("place_ready", "candidate_ready", "mart_publish_places", "mart_publish_new", "int_geocodes", "stg_places", "stg_geocodes", "stg_results", "stg_candidates", "dim_place", "results")}
    shown = ("address", "phone", "service", "kids")
    page = " OR ".join(f"({f}_displayable AND {f}_source_type = 'fb_page' AND NOT (verified_active AND fresh))" for f in shown)
    missed = " OR ".join(f"({f}_displayable AND {f}_source_type <> 'fb_page' AND NOT {f}_ok)" for f in shown)
    sums = lambda parts: " + ".join(f"(SELECT count(*) FROM {x})" for x in parts)
    both = lambda condition: sums(f"{at[n]} WHERE {condition}" for n in ("place_ready", "candidate_ready"))
    written = {"address": "address", "phone": "phone", "service": "service_times", "kids": "kids_program"}
    values = {"address": "street_address", "phone": "phone", "service": "service_times"}
    odd = lambda n, c, known: f"{at[n]} WHERE {c} NOT IN {known} AND NOT regexp_matches({c}, '{PACKAGE.replace('{', '{{').replace('}', '}}')}')"
    pins = f"SELECT latitude FROM {at['stg_geocodes']} WHERE geocode_status = 'ok' GROUP BY latitude, longitude HAVING count(DISTINCT {_key('geocoded_street', 'geocoded_city')}) > 1"
    counted = {
        "candidate_duplicates_are_not_new": sums([f"{at['candidate_ready']} WHERE is_new_place AND duplicate_of_place_id IS NOT NULL"]),
        "page_facts_are_fresh": both(page),
        "hidden_is_never_visit_ready": sums([f"{at['place_ready']} WHERE NOT is_in_scope AND visit_ready"]),
        "map_ready_has_a_current_pin": sums([f"{at['candidate_ready']} WHERE map_ready AND (NOT pin_usable OR latitude IS NULL OR longitude IS NULL)"]),
        "visit_ready_is_where_they_meet": sums([f"{at['place_ready']} WHERE visit_ready AND coalesce(address_is_worship_location, '') <> 'yes'"]),
        "holds_win": sums([f"{at['place_ready']} WHERE (hold_address AND address_displayable) OR (hold_service AND service_displayable)"]),
        "one_result_for_each_manifest_place": sums([f"(SELECT DISTINCT place_id FROM {{manifest}}) m LEFT JOIN (SELECT place_id, count(*) AS n FROM {at['results']} GROUP BY place_id) r USING (place_id) WHERE coalesce(n, 0) <> 1"]),
        "no_shared_pin_across_addresses": sums([f"({pins})"]),
        "new_places_are_not_in_the_directory": sums(["{mart_directory_matches}"]),
        "published_facts_have_a_source": sums(f"{at[n]} WHERE {v} IS NOT NULL AND {f}_source_url IS NULL" for n in ("mart_publish_places", "mart_publish_new") for f, v in written.items()),
        "usable_pins_are_inside_the_envelope": sums([f"{at['int_geocodes']} WHERE pin_usable AND NOT (latitude BETWEEN -15 AND 72 AND (longitude BETWEEN -180 AND -64 OR longitude BETWEEN 144 AND 180))"]),
        "joins_add_no_rows": f"abs((SELECT count(*) FROM {at['stg_places']}) - (SELECT count(*) FROM {at['dim_place']})) + abs((SELECT count(*) FROM {at['stg_candidates']}) - (SELECT count(*) FROM {at['candidate_ready']}))",
        "no_page_address_as_website": sums([f"{at['mart_publish_places']} WHERE contains(lower(website), 'facebook.com')"]),
        "finds_are_not_in_the_directory": sums([f"{at['stg_places']} WHERE source = 'found'"]),
        "labels_are_known": sums([odd("stg_results", "batch", KNOWN_BATCHES), odd("stg_results", "last_pass", KNOWN_PASSES), odd("stg_candidates", "task", KNOWN_TASKS)]),
        "no_personal_phone_is_kept": sums([f"{at['stg_results']} JOIN (SELECT place_id, display_phone FROM {at['dim_place']}) USING (place_id) WHERE personal_phone_withheld AND (phone IS NOT NULL OR display_phone IS NOT NULL)", f"{at['stg_candidates']} WHERE personal_phone_withheld AND phone IS NOT NULL"]),
        "shown_facts_were_found_again": both(missed),
        "street_name_alone_is_not_routable": sums([f"{at['place_ready']} WHERE has_routable_directory_address AND NOT has_house_number AND NOT has_google_address"]),
        "researched_facts_have_a_source": sums(f"{at['stg_results']} WHERE {v} IS NOT NULL AND ({f}_source_url IS NULL OR {f}_source_type IS NULL)" for f, v in values.items()),
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS assertion, ({n})::BIGINT AS violations" for name, n in counted.items())


def _violations(b: Build) -> DataFrame:
    counted = [rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("assertion"), "violations") for name, rows in assertions(b).items()]
    return reduce(DataFrame.unionAll, counted)


@query(_counts(""))
def assertions_all(t: Tables) -> DataFrame:
    """Every assertion with the number of rows that break it (Q3)."""
    return _violations(build(t))


@query(_counts("planted_"))
def assertions_fire(t: Tables) -> DataFrame:
    """Every assertion over relations with rows that break it (Q3)."""
    base = build(t)
    given = {"mart_directory_matches": base["mart_directory_matches"]}
    for name, (rows, values) in PLANTED.items():
        df = base[name]
        given[name] = df.withColumns({c: F.expr(f"CASE WHEN {rows} THEN {v} ELSE {c} END") for c, v in values.items()}) if values else df.where(f"NOT ({rows})")
    return _violations(Build(base.inputs, base.as_of, given))
