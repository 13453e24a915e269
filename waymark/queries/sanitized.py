"""Sanitised rows and coerced copies over whole tables (survey Q5, S15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import sanitizing
from waymark.queries import schedules  # noqa: F401  its fixtures are read here
from waymark.queries.registry import FIXTURES, Tables, query

_BAD = ("2026-10-19T17:40:00Z",)
FIXTURES.update({
    "answered": """
SELECT place_id, 'file' || CAST(place_id % 40 AS STRING) AS file, CASE WHEN place_id % 3 = 0 THEN '2026-10-20T00:00:00Z' ELSE '' END AS received_at,
  CASE place_id % 9 WHEN 0 THEN 'Personal number withheld.' WHEN 1 THEN 'pastor''s line' WHEN 2 THEN 'not identified as personal' WHEN 3 THEN 'a mobile, not a personal' WHEN 4 THEN NULL ELSE 'main office' END AS notes, CASE WHEN place_id % 4 = 0 THEN '' ELSE '555-' || CAST(1000 + place_id AS STRING) END AS phone,
  'http://p' AS phone_source_url, 'own_site' AS phone_source_type, CASE WHEN place_id % 13 = 0 THEN 'Cell: 555' END AS phone_excerpt,
  CASE place_id % 7 WHEN 0 THEN '2026-10-19T17:40:00Z' WHEN 1 THEN '2026-10-1' || CAST(place_id % 9 AS STRING) || 'T10:00:0' || CAST(place_id % 10 AS STRING) || 'Z' WHEN 2 THEN '2026-10-21T10:00Z' WHEN 3 THEN '19 Oct' WHEN 4 THEN '' WHEN 5 THEN '2026-10-11T11:11:11Z' END AS checked_at,
  schedule AS service_times, excerpt AS service_excerpt, CASE place_id % 3 WHEN 0 THEN 'english; 國語' WHEN 1 THEN 'Korean and korean' END AS service_languages, CASE WHEN place_id % 5 = 0 THEN '' ELSE CAST(place_id AS STRING) || ' Oak Street' END AS street_address,
  CASE place_id % 6 WHEN 0 THEN 'Visit ' || CAST(place_id AS STRING) || ' Oak St today' WHEN 1 THEN '1' || CAST(place_id AS STRING) || ' Oak Street' WHEN 2 THEN NULL ELSE 'at ' || CAST(place_id AS STRING) || ' OAK STREET' END AS address_excerpt, CASE place_id % 4 WHEN 0 THEN ' True' WHEN 1 THEN 'false' WHEN 2 THEN 'Unknown' END AS address_is_worship_location
FROM {schedules}""",
    "to_copy": """
SELECT c_custkey AS place_id, CASE c_custkey % 7 WHEN 0 THEN '{{"a": [1, 2]}}' WHEN 1 THEN '{{"a": 1' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN '"text"' WHEN 5 THEN 'text' ELSE '[]' END AS tags,
  CASE c_custkey % 6 WHEN 0 THEN '2026-02-03 04:05:06' WHEN 1 THEN '2026-13-01 00:00:00' WHEN 2 THEN '' WHEN 3 THEN 'soon' WHEN 4 THEN NULL ELSE '2026-02-28 23:59:59' END AS seen_at FROM {customer}""",
})


def _e(pattern: str) -> str:
    return "'" + pattern.replace("{", "{{").replace("}", "}}").replace("'", "''") + "'"


@query(f"""
WITH slots AS (SELECT * FROM {{schedule_slots}}),
lacking AS (SELECT DISTINCT k // 3 AS place_id FROM slots w WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM slots h WHERE h.k = w.k + 1 AND h.clock = w.clock AND (w.day IS NULL OR h.day = w.day) AND (w.act IS NULL OR h.act IS NULL OR h.act = w.act) AND (w.lang IS NULL OR h.lang = w.lang))),
plain AS (SELECT place_id, trim(regexp_replace(lower(coalesce(schedule, '')), '\\s+', ' ', 'g')) AS v, trim(regexp_replace(lower(coalesce(excerpt, '')), '\\s+', ' ', 'g')) AS e FROM {{schedules}}),
stated AS (SELECT place_id, lacking.place_id IS NULL OR (v <> '' AND instr(e, v) > 0 AND NOT (instr(e, v) > 1 AND regexp_matches(substr(e, instr(e, v) - 1, 1), '[\\pL\\pN]')) AND NOT regexp_matches(substr(e, instr(e, v) + length(v), 1), '[\\pL\\pN]')) AS ok FROM plain LEFT JOIN lacking USING (place_id)),
f AS (SELECT a.*, coalesce(phone, '') <> '' AND regexp_matches(regexp_replace(coalesce(notes, '') || ' ' || coalesce(phone_excerpt, ''), {_e(sanitizing.NOT_PERSONAL)}, '', 'g'), {_e(sanitizing.PERSONAL)}) OR contains(lower(coalesce(notes, '')), '{sanitizing.WITHHELD}') AS p,
    coalesce(checked_at = '{_BAD[0]}', false) OR (coalesce(checked_at, '') <> '' AND count(*) OVER (PARTITION BY file, checked_at) > {sanitizing.BULK}) OR (coalesce(checked_at, '') <> '' AND NOT regexp_matches(checked_at, {_e(sanitizing.STRICT_STAMP)})) OR (received_at <> '' AND coalesce(checked_at, '') > received_at) AS u,
    coalesce(service_times, '') <> '' AND coalesce(service_excerpt, '') <> '' AND NOT (regexp_matches(service_excerpt, {_e(sanitizing.STATED_TIME)}) AND s.ok) AS t, street_address <> '' AND NOT coalesce(regexp_matches(address_excerpt, '(?i)(^| )' || place_id || ' oak st(reet)?( |$)'), false) AS d
  FROM {{answered}} a JOIN stated s USING (place_id))
SELECT place_id, CASE WHEN p THEN '' ELSE phone END AS phone, CASE WHEN p THEN '' ELSE phone_source_url END AS phone_source_url, CASE WHEN u THEN '' ELSE checked_at END AS checked_at, CASE WHEN t THEN '' ELSE service_times END AS service_times, CASE WHEN d THEN '' ELSE street_address END AS street_address,
  CASE lower(trim(coalesce(address_is_worship_location, ''))) WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' ELSE lower(trim(coalesce(address_is_worship_location, ''))) END AS worship, CASE place_id % 3 WHEN 0 THEN 'English;Mandarin' WHEN 1 THEN 'Korean' ELSE '' END AS service_languages,
  concat_ws(',', CASE WHEN p THEN 'personal_phone' END, CASE WHEN u THEN 'unreliable_stamp' END, CASE WHEN d THEN 'unsupported_address' END, CASE WHEN t THEN 'unsupported_times' END) AS reasons FROM f""")
def sanitized_rows(t: Tables) -> DataFrame:
    """Returned rows without what may not be published, with the reasons."""
    out = sanitizing.sanitized(t.answered, "place_id", _BAD)
    return out.select("place_id", "phone", "phone_source_url", "checked_at", "service_times", "street_address", F.col("address_is_worship_location").alias("worship"), F.coalesce("service_languages", F.lit("")).alias("service_languages"), F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT place_id, nullif(trim(tags), '') AS tags, TRY_CAST(seen_at AS TIMESTAMP) AS seen_at, '' AS problems FROM {to_copy} WHERE (trim(coalesce(tags, '')) = '' OR json_valid(tags)) AND (coalesce(seen_at, '') = '' OR TRY_CAST(seen_at AS TIMESTAMP) IS NOT NULL)
UNION ALL SELECT place_id, tags, NULL, concat_ws(',', CASE WHEN trim(coalesce(tags, '')) <> '' AND NOT json_valid(tags) THEN 'tags: not JSON' END, CASE WHEN coalesce(seen_at, '') <> '' AND TRY_CAST(seen_at AS TIMESTAMP) IS NULL THEN 'seen_at: not a time' END) FROM {to_copy}
WHERE NOT ((trim(coalesce(tags, '')) = '' OR json_valid(tags)) AND (coalesce(seen_at, '') = '' OR TRY_CAST(seen_at AS TIMESTAMP) IS NOT NULL))""")
def coerced_copy(t: Tables) -> DataFrame:
    """A table copied with its types, and the rows that can't be, with why."""
    good, bad = sanitizing.coerced(t.to_copy, ["tags"], ["seen_at"])
    return good.withColumn("problems", F.lit("")).unionByName(bad.withColumns({"seen_at": F.lit(None).cast("timestamp"), "problems": F.array_join("problems", ",")}))
