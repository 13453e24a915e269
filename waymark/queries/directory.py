"""Queries over the stand-in directory: search, lists, similarity, reviews (survey 2.2-2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, jsonx, text
from waymark.operators import locating, search
from waymark.queries.registry import Tables, query

_CITY, _STATE = "nation_3", "s3"
_WANTED = search.Preferences(languages=("English", "korean"), worship=("Modern",), kids=("children", "youth"), weekday_care=True)

def _bands() -> F.Column:
    return F.when(F.col("band") == 0, F.array(F.lit("preschool"))).when(F.col("band") == 1, F.array(F.lit("children"), F.lit(None).cast("string"))).when(F.col("band") == 2, F.array(F.lit("young_adult"))).when(F.col("band") == 3, F.expr("cast(array() as array<string>)"))


def _programs(t: Tables) -> DataFrame:
    return t.programs.withColumn("age_bands", _bands())


_VISIBLE = "(scope_status IS NULL OR scope_status IN ('in_scope', 'in_scope_labeled'))"
_LANGUAGE_COUNT = "coalesce(json_array_length(tj->'service_languages'), 0)"
#: Joins and scores of the search, in SQL.
_BASE = f"""
WITH pj AS (SELECT *, CASE WHEN json_valid(tags) THEN tags::JSON END AS tj FROM {{places}}),
rv AS (SELECT place_id, count(*) AS review_count, avg(rating) AS avg_rating, avg(childrens_programs) AS avg_kids FROM {{reviews}} GROUP BY place_id),
pg AS (SELECT place_id, bool_or(band = 1) AS has_band, bool_or(band = 3) AS has_open, bool_or(program_type = 'weekday_care' AND band IN (1, 3)) AS has_care FROM {{programs}} GROUP BY place_id),
center AS (SELECT quantile_cont(latitude, 0.5) AS lat, quantile_cont(longitude, 0.5) AS lon FROM {{places}} WHERE lower(city) = '{_CITY}' AND lower(state) = '{_STATE}' AND {_VISIBLE} AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180),
middle AS (SELECT quantile_disc(latitude, 0.5) AS lat, quantile_disc(longitude, 0.5) AS lon FROM {{places}} WHERE lower(city) = '{_CITY}' AND lower(state) = '{_STATE}' AND latitude IS NOT NULL AND longitude IS NOT NULL),
scored AS (
  SELECT p.*, coalesce(review_count, 0) AS n_reviews, avg_rating,
    CASE WHEN coalesce(review_count, 0) > 0 THEN 3 ELSE 0 END + CASE WHEN trim(coalesce(service_times, '')) <> '' THEN 2 ELSE 0 END + CASE WHEN trim(coalesce(summary, '')) <> '' THEN 2 ELSE 0 END
      + CASE WHEN {_LANGUAGE_COUNT} > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(tj->>'worship_style', '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(json_array_length(tj->'programs'), 0) > 0 THEN 1 ELSE 0 END
      + CASE WHEN coalesce(tj->>'theological_stance', '') <> '' OR coalesce(json_array_length(tj->'statement_of_faith'), 0) > 0 THEN 1 ELSE 0 END AS profile_score,
    CASE WHEN len(list_filter(list_concat(coalesce(string_split(service_languages, ';'), []), CASE WHEN {_LANGUAGE_COUNT} > 0 THEN (tj->'service_languages')::VARCHAR[] ELSE [] END), lambda x: lower(trim(x)) IN ('english', 'korean'))) > 0 THEN 1.0 ELSE 0.0 END
      + CASE WHEN tj->>'worship_style' = 'Modern' THEN 1.0 ELSE 0.0 END
      + CASE WHEN has_band THEN 1.0 WHEN has_open OR trim(coalesce(kids_program, '')) <> '' OR (coalesce(json_array_length(tj->'programs'), 0) > 0 AND (tj->>'programs') ILIKE '%youth%') OR (review_count >= 3 AND avg_kids > 4.0) THEN 0.5 ELSE 0.0 END
      + CASE WHEN has_care THEN 1.0 ELSE 0.0 END AS fit_score
  FROM pj p LEFT JOIN rv USING (place_id) LEFT JOIN pg USING (place_id))
"""
_MILES = "CASE WHEN latitude IS NULL OR longitude IS NULL THEN NULL ELSE 3958.8 * 2 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(latitude - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(latitude)) * pow(sin(radians(longitude - {lon}) / 2), 2))))) END"
_CITY_MILES = _MILES.format(lat="center.lat", lon="center.lon")
_IN_CITY = f"lower(city) = '{_CITY}' AND lower(state) = '{_STATE}' AND {_VISIBLE}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_miles", F.round("distance_miles", 6))


def _search_sql(order: str, limit: int, offset: int = 0) -> str:
    return _BASE + f"""
SELECT place_id, name, city, state, n_reviews AS review_count, round(avg_rating, 1) AS avg_rating, round(distance_miles, 6) AS distance_miles, fit_score, profile_score, total_count
FROM (SELECT s.*, {_CITY_MILES} AS distance_miles, count(*) OVER () AS total_count FROM scored s, center WHERE {_IN_CITY})
ORDER BY {order}, name, place_id LIMIT {limit} OFFSET {offset}"""


@query(_search_sql("fit_score DESC, profile_score DESC, distance_miles ASC NULLS LAST", 25))
def search_for_you(t: Tables) -> DataFrame:
    """The flagship: a city ranked by what a visitor wants."""
    return _rounded(search.search(t.places, t.reviews, _programs(t), search.Request(city=_CITY, state=_STATE, sort="for_you", wanted=_WANTED, limit=25)))


@query(_search_sql("distance_miles ASC NULLS LAST, profile_score DESC", 10, 20))
def search_nearest_page(t: Tables) -> DataFrame:
    """The third page of a city by distance to its center."""
    return _rounded(search.search(t.places, t.reviews, _programs(t), search.Request(city=_CITY, state=_STATE, wanted=_WANTED, limit=10, offset=20)))


@query(_BASE + f"""
SELECT place_id, name, city, state, n_reviews AS review_count, round(avg_rating, 1) AS avg_rating, round(distance_miles, 6) AS distance_miles, fit_score, profile_score, count(*) OVER () AS total_count
FROM (SELECT s.*, {_MILES.format(lat="34.0", lon="-118.0")} AS distance_miles FROM scored s WHERE {_VISIBLE} AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
WHERE distance_miles <= 250 ORDER BY distance_miles ASC NULLS LAST, profile_score DESC, name, place_id LIMIT 40""")
def search_radius(t: Tables) -> DataFrame:
    """Places within 250 miles of a point."""
    return _rounded(search.search(t.places, t.reviews, _programs(t), search.Request(near=(34.0, -118.0, 250.0), wanted=_WANTED, limit=40)))


@query(_BASE + f"""
SELECT place_id, name, n_reviews AS review_count, CASE WHEN lower(name) = 'customer#000000012' THEN 0 WHEN lower(name) LIKE 'customer#000000012%' THEN 1 ELSE 2 END AS tier, profile_score
FROM scored WHERE {_VISIBLE} AND strpos(lower(name), lower('Customer#00000001')) > 0
ORDER BY CASE WHEN lower(name) = 'customer#00000001' THEN 0 WHEN lower(name) LIKE 'customer#00000001%' THEN 1 ELSE 2 END, profile_score DESC, n_reviews DESC, name, city ASC NULLS LAST, state ASC NULLS LAST, place_id LIMIT 30""".replace("'customer#000000012'", "'customer#00000001'").replace("'customer#000000012%'", "'customer#00000001%'"))
def search_name_rank(t: Tables) -> DataFrame:
    """Names that hold a text, by relevance."""
    return search.by_name(t.places, t.reviews, "Customer#00000001", 30).select("place_id", "name", "review_count", "tier", "profile_score")


@query(_BASE + f"""
SELECT place_id, name, n_reviews AS review_count, summary IS NOT NULL OR tags IS NOT NULL AS described FROM scored WHERE {_IN_CITY}
ORDER BY described DESC, n_reviews DESC, name, place_id LIMIT 20""")
def city_default(t: Tables) -> DataFrame:
    """A city, described and reviewed places first (O1)."""
    return search.city_list(t.places, t.reviews, _CITY, _STATE, 20).select("place_id", "name", "review_count", "described")


@query(_BASE + f"""
SELECT place_id, profile_score, round(sqrt(pow(latitude - middle.lat, 2) + pow(longitude - middle.lon, 2)), 6) AS from_middle FROM scored, middle WHERE {_IN_CITY}
ORDER BY profile_score DESC, sqrt(pow(latitude - middle.lat, 2) + pow(longitude - middle.lon, 2)) ASC NULLS LAST, name, place_id LIMIT 20""")
def city_starting_point(t: Tables) -> DataFrame:
    """A city by profile and distance to its middle (A10, M3, M8, O2)."""
    return search.city_list(t.places, t.reviews, _CITY, _STATE, 20, "starting_point").select("place_id", "profile_score", F.round("from_middle", 6).alias("from_middle"))


@query(_BASE + "SELECT center.lat AS center_lat, center.lon AS center_lon, middle.lat AS median_lat, middle.lon AS median_lon FROM center, middle")
def city_medians(t: Tables) -> DataFrame:
    """The interpolated and the discrete median of a city."""
    return search.city_center(t.places, _CITY, _STATE).crossJoin(search.city_median(t.places, _CITY, _STATE))


@query(f"SELECT place_id, name FROM {{places}} WHERE {_VISIBLE} AND place_id > 500 ORDER BY place_id LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    """The next page by key."""
    return search.after(t.places.where(search.visible()).select("place_id", "name"), "place_id", 500, 50)


@query("SELECT place_id, name, city FROM {places} WHERE zip_code = '90007' ORDER BY place_id LIMIT 10")
def postcode_list(t: Tables) -> DataFrame:
    """A postcode's places; the order is imposed."""
    return t.places.where("zip_code = '90007'").orderBy("place_id").limit(10).select("place_id", "name", "city")


@query("SELECT place_id, name, address FROM {places} WHERE place_id = 77 AND " + _VISIBLE)
def point_lookup(t: Tables) -> DataFrame:
    """One place, if it is shown."""
    return t.places.where((F.col("place_id") == 77) & search.visible()).select("place_id", "name", "address")


_VECTORS = "SELECT place_id, avg(rating) AS rating, avg(childrens_programs) AS childrens_programs, avg(sermon_depth) AS sermon_depth FROM {reviews} GROUP BY place_id"


@query(f"""
WITH v AS ({_VECTORS}), x AS (SELECT * FROM v WHERE place_id = 4)
SELECT v.place_id, round(pow(coalesce(v.rating, 0) - coalesce(x.rating, 0), 2) + pow(coalesce(v.childrens_programs, 0) - coalesce(x.childrens_programs, 0), 2) + pow(coalesce(v.sermon_depth, 0) - coalesce(x.sermon_depth, 0), 2), 9) AS distance
FROM v, x WHERE v.place_id <> 4 ORDER BY pow(coalesce(v.rating, 0) - coalesce(x.rating, 0), 2) + pow(coalesce(v.childrens_programs, 0) - coalesce(x.childrens_programs, 0), 2) + pow(coalesce(v.sermon_depth, 0) - coalesce(x.sermon_depth, 0), 2), v.place_id LIMIT 3""")
def similar_topk(t: Tables) -> DataFrame:
    """The three places most like one, by their ratings."""
    dims = ["rating", "childrens_programs", "sermon_depth"]
    vectors = t.reviews.groupBy("place_id").agg(*[F.avg(d).alias(d) for d in dims])
    return search.similar(vectors, 4, dims).select("place_id", F.round("distance", 9).alias("distance"))


@query("""
SELECT place_id, count(*) AS review_count, round(avg(rating), 1) AS avg_rating, round(avg(childrens_programs), 2) AS avg_childrens_programs, count(childrens_programs) AS rated_programs, max(created_at) AS newest
FROM {reviews} GROUP BY place_id""")
def review_averages(t: Tables) -> DataFrame:
    """Averages by place over what was rated."""
    return t.reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("review_count"), F.round(F.avg("rating"), 1).alias("avg_rating"), F.round(F.avg("childrens_programs"), 2).alias("avg_childrens_programs"), F.count("childrens_programs").alias("rated_programs"), F.max("created_at").alias("newest"))


@query("SELECT review_id, created_at FROM {reviews} WHERE place_id = 4 ORDER BY created_at DESC NULLS FIRST, review_id DESC LIMIT 10")
def newest_reviews(t: Tables) -> DataFrame:
    """A place's reviews, newest first."""
    return t.reviews.where("place_id = 4").orderBy(F.desc_nulls_first("created_at"), F.desc("review_id")).limit(10).select("review_id", "created_at")


@query("""
SELECT place_id, string_agg(id || ':' || program_type, ',' ORDER BY CASE band WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END, id) AS programs FROM {programs} GROUP BY place_id""")
def programs_by_band(t: Tables) -> DataFrame:
    """A place's programs, those for the youngest first."""
    first = F.when(F.array_contains("age_bands", "preschool"), 0).when(F.array_contains("age_bands", "children"), 1).when(F.array_contains("age_bands", "youth"), 2).when(F.array_contains("age_bands", "young_adult"), 3).otherwise(4)
    rows = _programs(t).groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("band"), "id", "program_type"))).alias("p"))
    return rows.select("place_id", F.array_join(F.transform("p", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["program_type"])), ",").alias("programs"))


@query("""
WITH s AS (SELECT place_id, count(*) AS n, avg(rating) AS r, avg(childrens_programs) AS k, avg(sermon_depth) AS d FROM {reviews} GROUP BY place_id)
SELECT place_id, array_to_string(list_filter([CASE WHEN n >= 3 AND d > 4.3 THEN 'Deep teaching' END, CASE WHEN n >= 3 AND k > 4.0 THEN 'Great for kids' END], lambda x: x IS NOT NULL), ',') AS tags FROM s""")
def rating_tags(t: Tables) -> DataFrame:
    """What ratings say from three reviews on."""
    none = F.lit(None).cast("double")
    s = t.reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("review_count"), F.avg("childrens_programs").alias("avg_childrens_programs"), F.avg("sermon_depth").alias("avg_sermon_depth"))
    s = s.withColumns({f"avg_{c}": none for c in ("worship_energy", "community_warmth", "theological_openness", "facilities")})
    return s.select("place_id", F.array_join(search.rating_tags(), ",").alias("tags"))


@query("""
SELECT place_id, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS name_key, nullif(trim(address, ' '), '') AS street,
  lower(regexp_replace(trim(coalesce(address, '') || '|' || coalesce(city, '') || '|' || coalesce(zip_code, ''), ' '), '\\s+', ' ', 'g')) AS address_key,
  coalesce(regexp_matches(address, '^\\s*[0-9]'), false) AS has_house_number,
  coalesce(latitude BETWEEN -15 AND 72 AND (longitude BETWEEN -180 AND -64 OR longitude BETWEEN 144 AND 180) AND NOT (latitude = 0 AND longitude = 0), false) AS coords_ok,
  right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone_digits, sha256(name) AS name_hash
FROM {places}""")
def clean_keys(t: Tables) -> DataFrame:
    """Cleaned texts, keys, hashes and flags of every place."""
    return t.places.select(
        "place_id", text.name_key("name").alias("name_key"), text.clean("address").alias("street"), text.address_key(F.col("address"), F.col("city"), F.col("zip_code")).alias("address_key"),
        F.coalesce(F.rlike("address", F.lit(r"^\s*[0-9]")), F.lit(False)).alias("has_house_number"), geo.in_envelope(F.col("latitude"), F.col("longitude")).alias("coords_ok"),
        F.right(F.regexp_replace("phone", r"\D", ""), F.lit(10)).alias("phone_digits"), text.content_hash("name").alias("name_hash"),
    )


@query("""
SELECT language, city, count(*) AS places FROM (SELECT city, trim(unnest(string_split(service_languages, ';'))) AS language FROM {places}) WHERE language <> '' GROUP BY language, city""")
def explode_languages(t: Tables) -> DataFrame:
    """Places by stated language and city."""
    return jsonx.explode_list(t.places, "service_languages", "language").groupBy("language", "city").agg(F.count(F.lit(1)).alias("places"))


@query("""
WITH pj AS (SELECT *, CASE WHEN json_valid(tags) THEN tags::JSON END AS tj FROM {places})
SELECT place_id, tj->>'worship_style' AS style, coalesce(json_array_length(tj->'service_languages'), 0) > 0 AS has_languages, coalesce(lower(tj->>'theological_stance') = 'moderate', false) AS moderate,
  CASE WHEN coalesce(json_array_length(tj->'service_languages'), 0) > 0 THEN array_to_string((tj->'service_languages')::VARCHAR[], ',') ELSE '' END AS languages
FROM pj""")
def json_guards(t: Tables) -> DataFrame:
    """Fields of JSON texts of any shape."""
    return t.places.select("place_id", jsonx.at("tags", "worship_style").alias("style"), jsonx.filled_array("tags", "service_languages").alias("has_languages"), jsonx.folded_equal("tags", "theological_stance", "Moderate").alias("moderate"), F.array_join(jsonx.strings("tags", "service_languages"), ",").alias("languages"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, (props->>'k')::BIGINT % 2 = 0 AS is_even FROM {events} WHERE coalesce((props->>'k')::BIGINT, 0) > 50")
def event_props(t: Tables) -> DataFrame:
    """A number in JSON text."""
    k = jsonx.at("props", "k").try_cast("long")
    return t.events.select("event_id", k.alias("k"), (k % 2 == 0).alias("is_even")).where(F.coalesce("k", F.lit(0)) > 50)


@query("""
SELECT doc_id, sha256(text) AS digest, substr(sha256('doc' || ':' || source || ':' || lang), 1, 16) AS short_key FROM {documents}""")
def content_hashes(t: Tables) -> DataFrame:
    """Hashes of whole texts."""
    return t.documents.select("doc_id", text.content_hash("text").alias("digest"), F.substring(F.sha2(F.concat(F.lit("doc:"), "source", F.lit(":"), "lang"), 256), 1, 16).alias("short_key"))


@query("""
WITH w AS (SELECT doc_id, text AS t, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '') AS w FROM {documents}),
q AS (SELECT doc_id, t, CASE WHEN doc_id % 3 = 0 THEN translate(array_to_string(w[3:6], ' '), 'aeiou', 'AEIOU') ELSE array_to_string(w[3:6], ' ') END AS e FROM w),
x AS (SELECT *, (length(t) - length(replace(t, e, ''))) // nullif(length(e), 0) AS n, (length(t) - length(replace(lower(t), lower(e), ''))) // nullif(length(e), 0) AS m FROM q)
SELECT doc_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' WHEN m = 1 THEN 'folded' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
  CASE WHEN n = 1 THEN strpos(t, e) - 1 WHEN n = 0 AND m = 1 THEN strpos(lower(t), lower(e)) - 1 END AS start FROM x""")
def locate_once(t: Tables) -> DataFrame:
    """Where four words of each document stand in its whole text, if once; vowels of every third document's in capitals."""
    words = F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "")
    quoted = F.array_join(F.slice(words, 3, 4), " ")
    quoted = F.when(F.col("doc_id") % 3 == 0, F.translate(quoted, "aeiou", "AEIOU")).otherwise(quoted)
    return t.documents.select("doc_id", text.locate_once(quoted, F.col("text")).alias("at")).select("doc_id", "at.status", "at.start")


@query("""
WITH x AS (SELECT doc_id, item_id, d.text AS t, b.text AS e, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS n, (length(d.text) - length(replace(lower(d.text), lower(b.text), ''))) // length(b.text) AS m
  FROM {documents} d JOIN {benchmark} b ON (contains(lower(d.text), lower(b.text)) OR contains(d.text, b.text)) AND trim(b.text) <> '')
SELECT doc_id, item_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' WHEN m = 1 THEN 'folded' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN strpos(t, e) - 1 WHEN n = 0 AND m = 1 THEN strpos(lower(t), lower(e)) - 1 END AS start FROM x""")
def locate_every(t: Tables) -> DataFrame:
    """Where each item stands in each document that holds it in any case (T11); pairs that aren't there are missing."""
    met = locating.holders(t.documents, t.benchmark.withColumnRenamed("text", "item"), "doc_id", "item_id")
    return met.select("doc_id", "item_id", text.locate_once(F.col("item"), F.col("text")).alias("at")).select("doc_id", "item_id", "at.status", "at.start")
