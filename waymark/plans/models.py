"""The directory's derived relations, from staged inputs to what is published (survey 2.15).

Each model is a function of a Build, which resolves the models it reads; nothing runs until a result is asked for, so
Spark plans a mart and all below it as one query. Inputs: places, snapshot_meta, manifest, results, candidates,
source_checks, geocodes, quality_reviews, fact_holds, tradition_scope.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, jsonx
from waymark.functions.text import address_key, clean, differs, name_key
from waymark.operators.stats import rolled_up, shared_values, with_overlapping_scopes

MODELS: dict[str, Callable[[Build], DataFrame]] = {}


class Build:
    """Inputs by name, the date as of which facts are fresh, and the models that have been asked for."""

    def __init__(self, inputs: Mapping[str, DataFrame], as_of: date, given: Mapping[str, DataFrame] | None = None):
        """given: models that are taken as they are instead of being made."""
        self.inputs, self.as_of, self._made = inputs, as_of, dict(given or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = MODELS[name](self) if name in MODELS else self.inputs[name]
        return self._made[name]


def model(function: Callable[[Build], DataFrame]) -> Callable[[Build], DataFrame]:
    MODELS[function.__name__] = function
    return function


def displayable(has_fact: Column, source_type: Column, verified: Column, active: Column, page_fresh: Column, hold: Column | None = None) -> Column:
    """a fact may be shown if its own site or tradition states it and the excerpt was found, or if the place's own page does, it is active and the page fresh. A hold wins."""
    shown = (source_type.isin("own_site", "denomination") & verified) | ((source_type == "fb_page") & active & page_fresh)
    return has_fact & shown if hold is None else has_fact & ~hold & shown


def _blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(c, F.lit("")) for c in columns})


FACTS = ("status", "address", "phone", "service", "kids")


@model
def stg_places(b: Build) -> DataFrame:
    """a row for each record of the directory, cleaned; published finds aren't part of it."""
    p = b["places"].where(differs(F.col("source"), F.lit("found")))
    return p.select(
        "place_id", clean("name").alias("listed_name"), clean("address").alias("street_text"), F.coalesce(F.rlike("address", F.lit(r"^\s*[0-9]")), F.lit(False)).alias("has_house_number"),
        F.coalesce("has_google_address", F.lit(False)).alias("has_google_address"), clean("city").alias("city"), clean("state").alias("state"), clean("zip_code").alias("zip"), "latitude", "longitude",
        geo.in_envelope(F.col("latitude"), F.col("longitude")).alias("coords_ok"), clean("website").alias("website"), clean("phone").alias("phone"), F.coalesce("source", F.lit("unknown")).alias("source"),
        "external_id", clean("denomination").alias("denomination"),
    )


@model
def stg_published(b: Build) -> DataFrame:
    """A row for each published find: the candidate owns its facts."""
    p = b["places"].where("source = 'found'")
    return p.select("place_id", F.col("external_id").alias("candidate_id"), clean("name").alias("published_name"), clean("address").alias("published_street"), clean("city").alias("city"), "latitude", "longitude")


_RESULT_TEXTS = [
    "status_source_type", "status_source_url", "current_name", "official_url", "url_evidence", "facebook_page_url", "fb_page_evidence", "street_address", "city", "zip", "address_source_url", "address_source_type",
    "address_is_worship_location", "pin_check", "phone", "phone_source_url", "phone_source_type", "service_times", "service_languages", "service_source_url", "service_source_type", "kids_program", "kids_source_url", "kids_source_type",
]


@model
def stg_results(b: Build) -> DataFrame:
    """A row for each researched record of the directory."""
    return _blank_to_null(b["results"], _RESULT_TEXTS)


@model
def stg_candidates(b: Build) -> DataFrame:
    """A row for each find outside the directory; new if it is neither a duplicate nor an addition to something known."""
    c = _blank_to_null(b["candidates"], [x for x in _RESULT_TEXTS if x not in ("current_name", "pin_check")] + ["possible_match_candidate_id", "denomination_stated"])
    return c.withColumn("is_new_place", F.col("duplicate_of_place_id").isNull() & F.col("possible_match_place_id").isNull() & F.col("possible_match_candidate_id").isNull())


@model
def stg_checks(b: Build) -> DataFrame:
    """A row for each subject and group of facts."""
    return b["source_checks"].select("subject_type", "subject_id", "fact_group", "verdict", (F.col("verdict") == "verified").alias("is_verified"), "checked_at")


@model
def stg_geocodes(b: Build) -> DataFrame:
    """A row for each geocoded subject, with the address that was geocoded."""
    return _blank_to_null(b["geocodes"], ["match_type", "matched_address", "geocoded_street", "geocoded_city", "geocoded_zip"]).withColumnRenamed("status", "geocode_status")


@model
def int_scope(b: Build) -> DataFrame:
    """What the map shows of each place, and why. Research on the place itself comes before its tradition's label, that before its name."""
    t = b["tradition_scope"].select("denomination_key", F.col("scope_status").alias("label"), "display_tradition")
    r = b["stg_results"].select("place_id", "entity_type", "duplicate_of_place_id")
    d = b["stg_places"].join(t, F.lower("denomination") == F.col("denomination_key"), "left").join(r, "place_id", "left")
    house = F.rlike("listed_name", F.lit("(?i)(convent|monastery|abbey|motherhouse|^sisters of)"))
    kind, label = F.col("entity_type"), F.col("label")
    settles = (kind == "congregation") & (label == "pending")
    status = (
        F.when(F.col("duplicate_of_place_id").isNotNull(), "duplicate").when(kind == "non_christian", "out_of_scope").when(kind.isin("religious_house", "business"), "not_a_congregation")
        .when(kind == "unknown", "pending").when(settles, "in_scope").when(label.isNotNull(), label).when(house, "not_a_congregation").otherwise("in_scope")
    )
    basis = (
        F.when(F.col("duplicate_of_place_id").isNotNull() | (kind != "congregation") | settles, "research").when(label.isNotNull(), "denomination").when(house, "name_pattern")
        .when(kind == "congregation", "research").otherwise("default")
    )
    return d.select("place_id", status.alias("scope_status"), "display_tradition", basis.alias("scope_basis"))


@model
def int_clusters(b: Build) -> DataFrame:
    """M5, A5: places that share a point of four decimals with three others or more."""
    grid = b["stg_places"].where("latitude is not null").select("place_id", geo.cell(F.col("latitude")).alias("lat4"), geo.cell(F.col("longitude")).alias("lon4"))
    return shared_values(grid, ["lat4", "lon4"], 3).select("place_id", F.col("sharing").alias("records_at_point"))


@model
def int_geocodes(b: Build) -> DataFrame:
    """A pin is usable while the record still has the address that was geocoded."""
    found = b["stg_candidates"].select(F.lit("candidate").alias("subject_type"), F.col("candidate_id").alias("subject_id"), "street_address", "city", "zip")
    listed = b["stg_places"].select("place_id", F.col("city").alias("listed_city"))
    known = b["stg_results"].join(listed, "place_id").select(F.lit("place").alias("subject_type"), F.col("place_id").cast("string").alias("subject_id"), "street_address", F.coalesce("city", "listed_city").alias("city"), "zip")
    g = b["stg_geocodes"].join(found.unionByName(known), ["subject_type", "subject_id"], "left")
    same = F.coalesce(address_key(F.col("geocoded_street"), F.col("geocoded_city"), F.col("geocoded_zip")) == address_key(F.col("street_address"), F.col("city"), F.col("zip")), F.lit(False))
    ok = (F.col("geocode_status") == "ok") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & same
    return g.select("subject_type", "subject_id", "geocode_status", "latitude", "longitude", "matched_address", "distance_from_current_pin_m", F.col("street_address").alias("current_street"), same.alias("address_unchanged"), ok.alias("pin_usable"))


def _verified(checks: DataFrame, subject_type: str, key: Column) -> DataFrame:
    """A row for each subject, a flag for each group of facts."""
    flags = [F.bool_or((F.col("fact_group") == f) & F.col("is_verified")).alias(f"{f}_source_verified") for f in FACTS]
    return checks.where(F.col("subject_type") == subject_type).groupBy(key).agg(*flags)


def _shown(df: DataFrame, holds: Mapping[str, Column]) -> DataFrame:
    values = {"address": "street_address", "phone": "phone", "service": "service_times", "kids": "kids_program"}
    return df.withColumns({f"{f}_displayable": displayable(F.col(v).isNotNull(), F.col(f"{f}_source_type"), F.col(f"{f}_source_verified"), F.col("verified_active"), F.col("fb_page_fresh"), holds.get(f)) for f, v in values.items()})


def _evidence(df: DataFrame, as_of: date) -> DataFrame:
    """D1 and what follows from it: activity, links and pages that hold up."""
    fresh = F.coalesce(F.col("fb_last_post_date") >= F.date_sub(F.lit(as_of), 365), F.lit(False))
    df = df.withColumns({f"{f}_source_verified": F.coalesce(f"{f}_source_verified", F.lit(False)) for f in FACTS})
    active = F.coalesce(displayable(F.col("status") == "active", F.col("status_source_type"), F.col("status_source_verified"), F.lit(True), fresh), F.lit(False))
    return df.withColumns({
        "fb_page_fresh": fresh, "verified_active": active, "website_verified": F.col("official_url").isNotNull() & (F.coalesce("url_evidence", F.lit("name_only")) != "name_only"),
        "fb_page_linkable": F.col("facebook_page_url").isNotNull() & F.col("fb_page_evidence").isNotNull(),
    })


def _reachable() -> Column:
    return F.col("website_verified") | (F.col("fb_page_linkable") & F.col("fb_page_fresh")) | F.col("phone_displayable")


@model
def int_place_readiness(b: Build) -> DataFrame:
    """A row for each place with all its flags, up to visit_ready."""
    results = b["stg_results"].drop("duplicate_of_place_id", "entity_type").withColumnsRenamed({"city": "result_city", "zip": "result_zip", "phone": "result_phone"}).withColumn("researched", F.lit(True))
    holds = b["fact_holds"].groupBy("place_id").agg(F.bool_or(F.col("field") == "street_address").alias("hold_address"), F.bool_or(F.col("field") == "service_times").alias("hold_service"))
    checks = _verified(b["stg_checks"], "place", F.col("subject_id").try_cast("long").alias("place_id"))
    pins = b["int_geocodes"].where("subject_type = 'place'").select(F.col("subject_id").try_cast("long").alias("place_id"), "pin_usable", F.col("latitude").alias("pin_latitude"), F.col("longitude").alias("pin_longitude"), F.col("distance_from_current_pin_m").alias("pin_moves"))
    clusters = b["int_clusters"].select("place_id", F.lit(True).alias("in_repeated_cluster"))
    d = b["stg_places"].drop("phone", "website").join(b["int_scope"], "place_id").join(clusters, "place_id", "left").join(results, "place_id", "left").join(holds, "place_id", "left").join(checks, "place_id", "left").join(pins, "place_id", "left")
    d = _evidence(d.withColumnRenamed("result_phone", "phone"), b.as_of)
    d = d.withColumns({
        "researched": F.coalesce("researched", F.lit(False)), "in_pilot": F.coalesce(F.col("batch").isin("A_calibration", "B_main"), F.lit(False)), "is_in_scope": F.col("scope_status").isin("in_scope", "in_scope_labeled"),
        "has_street_text": F.col("street_text").isNotNull(), "has_routable_directory_address": (F.col("has_house_number") | F.col("has_google_address")) & F.col("city").isNotNull() & F.col("state").isNotNull(),
        "in_repeated_cluster": F.coalesce("in_repeated_cluster", F.lit(False)), "hold_address": F.coalesce("hold_address", F.lit(False)), "hold_service": F.coalesce("hold_service", F.lit(False)),
        "proposed_pin_usable": F.coalesce("pin_usable", F.lit(False)), "proposed_latitude": F.when(F.col("pin_usable"), F.col("pin_latitude")), "proposed_longitude": F.when(F.col("pin_usable"), F.col("pin_longitude")),
        "proposed_pin_moves_m": F.when(F.col("pin_usable"), F.col("pin_moves")),
    })
    d = _shown(d, {"address": F.col("hold_address"), "service": F.col("hold_service")})
    ready = F.col("is_in_scope") & F.col("verified_active") & F.col("address_displayable") & (F.coalesce("address_is_worship_location", F.lit("")) == "yes") & F.col("coords_ok") & (F.coalesce("pin_check", F.lit("unknown")) != "off") & _reachable()
    return d.withColumn("visit_ready", ready)


@model
def int_candidate_readiness(b: Build) -> DataFrame:
    """A row for each candidate, up to profile_ready and map_ready."""
    checks = _verified(b["stg_checks"], "candidate", F.col("subject_id").alias("candidate_id"))
    pins = b["int_geocodes"].where("subject_type = 'candidate'").select(F.col("subject_id").alias("candidate_id"), "geocode_status", "pin_usable", "latitude", "longitude")
    d = _evidence(b["stg_candidates"].join(checks, "candidate_id", "left").join(pins, "candidate_id", "left"), b.as_of)
    d = d.withColumns({"pin_usable": F.coalesce("pin_usable", F.lit(False)), "latitude": F.when(F.col("pin_usable"), F.col("latitude")), "longitude": F.when(F.col("pin_usable"), F.col("longitude"))})
    d = _shown(d, {})
    ready = F.col("is_new_place") & F.col("verified_active") & F.col("address_displayable") & (F.coalesce("address_is_worship_location", F.lit("")) == "yes") & _reachable()
    d = d.withColumn("profile_ready", ready)
    return d.withColumns({"map_ready": F.col("profile_ready") & F.col("pin_usable"), "needs_geocode": ~F.col("pin_usable")})


@model
def dim_place(b: Build) -> DataFrame:
    """What may be shown of each place."""
    when = lambda flag, column: F.when(F.col(flag), F.col(column))
    r = b["int_place_readiness"]
    return r.select(
        "place_id", F.coalesce("current_name", "listed_name").alias("display_name"), "listed_name", "denomination", "display_tradition", "scope_status", "scope_basis", "source", "external_id",
        F.coalesce("result_city", "city").alias("city"), "state", "latitude", "longitude", "in_pilot", "batch", "status", "verified_active", when("address_displayable", "street_address").alias("display_street_address"),
        when("address_displayable", "result_zip").alias("display_zip"), when("address_displayable", "address_source_type").alias("address_source_type"), when("phone_displayable", "phone").alias("display_phone"),
        when("service_displayable", "service_times").alias("display_service_times"), "service_languages", when("kids_displayable", "kids_program").alias("display_kids_program"), when("website_verified", "official_url").alias("verified_website"),
        when("fb_page_linkable", "facebook_page_url").alias("facebook_page_url"), "fb_last_post_date", "has_routable_directory_address", "coords_ok", "in_repeated_cluster", "address_displayable", "phone_displayable", "service_displayable",
        "kids_displayable", "visit_ready", "proposed_pin_usable", "proposed_latitude", "proposed_longitude", "proposed_pin_moves_m", "checked_at", "last_pass",
    )


@model
def mart_coverage(b: Build) -> DataFrame:
    """The funnel by scope and source; a record counts once in all and once in each of its scopes."""
    scope = F.when(F.col("batch").isin("A_calibration", "B_main"), "pilot").otherwise(F.concat(F.lit("batch_"), F.col("batch")))
    membership = b["manifest"].select("place_id", scope.alias("geo_scope"))
    r = with_overlapping_scopes(b["int_place_readiness"], membership, "place_id", "geo_scope", "national")
    flags = {
        "researched": "researched", "in_scope": "is_in_scope", "street_text": "has_street_text", "house_numbered": "has_house_number", "routable_directory_address": "has_routable_directory_address", "coords_ok": "coords_ok",
        "in_repeated_cluster": "in_repeated_cluster", "verified_active": "verified_active", "verified_address": "address_displayable", "kids_program_shown": "kids_displayable", "visit_ready": "visit_ready",
    }
    counts = [F.count(F.lit(1)).alias("records"), F.count_if(F.col("scope_status") == "in_scope_labeled").alias("in_scope_labeled"), F.count_if(~F.col("is_in_scope")).alias("hidden_by_scope"), *[F.count_if(c).alias(n) for n, c in flags.items()]]
    out = r.groupBy("geo_scope", "source").agg(*counts)
    return out.crossJoin(F.broadcast(b["snapshot_meta"].select("snapshot_source", "snapshot_taken_at"))).withColumn("as_of_date", F.lit(b.as_of))


@model
def mart_language_supply(b: Build) -> DataFrame:
    """Where a language is spoken, as the places state it."""
    r = b["int_place_readiness"].where("is_in_scope and service_languages is not null").select(F.lit("directory").alias("origin"), F.coalesce("result_city", "city").alias("city"), "service_languages", "verified_active", "service_displayable", "kids_displayable", F.col("visit_ready").alias("ready"))
    c = b["int_candidate_readiness"].where("is_new_place and service_languages is not null").select(F.lit("new").alias("origin"), "city", "service_languages", "verified_active", "service_displayable", "kids_displayable", F.col("profile_ready").alias("ready"))
    rows = jsonx.explode_list(r.unionByName(c), "service_languages", "language")
    return rows.groupBy("language", "city", "origin").agg(F.count(F.lit(1)).alias("places"), F.count_if("verified_active").alias("active"), F.count_if("service_displayable").alias("with_shown_service_times"), F.count_if("kids_displayable").alias("with_shown_kids_program"), F.count_if("ready").alias("ready"))


@model
def mart_scorecard(b: Build) -> DataFrame:
    """A3: what each pass found, and all of them."""
    r = b["int_place_readiness"].where("researched")
    page = lambda f: F.count_if(F.col(f"{f}_displayable") & (F.col(f"{f}_source_type") == "fb_page"))
    has_address = F.col("street_address").isNotNull()
    counts = [
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "unresolved").alias("unresolved"), F.count_if(F.col("status").isin("closed", "merged")).alias("closed_or_merged"),
        F.count_if(~F.col("is_in_scope")).alias("hidden_by_scope"), F.count_if(has_address).alias("address_found"), F.count_if("address_displayable").alias("address_displayable"), F.count_if(has_address & ~F.col("address_displayable")).alias("address_needs_review"),
        F.count_if(has_address & F.col("address_source_type").isin("own_site", "denomination") & ~F.col("address_source_verified")).alias("address_failed_recheck"), F.count_if("phone_displayable").alias("phone_displayable"),
        F.count_if("service_displayable").alias("service_displayable"), F.count_if(F.col("kids_program").isNotNull()).alias("kids_found"), F.count_if("kids_displayable").alias("kids_displayable"), F.count_if("fb_page_linkable").alias("fb_page_linkable"),
        (page("address") + page("phone") + page("service")).alias("fb_only_facts_shown"), F.count_if("visit_ready").alias("visit_ready"),
    ]
    return rolled_up(r, "last_pass", counts)


@model
def mart_new_places(b: Build) -> DataFrame:
    """what may be shown of each new find."""
    when = lambda flag, column: F.when(F.col(flag), F.col(column))
    return b["int_candidate_readiness"].where("is_new_place").select(
        "candidate_id", "candidate_name", "city", when("address_displayable", "street_address").alias("display_street_address"), when("address_displayable", "zip").alias("display_zip"), when("website_verified", "official_url").alias("verified_website"),
        when("fb_page_linkable", "facebook_page_url").alias("facebook_page_url"), when("phone_displayable", "phone").alias("display_phone"), when("service_displayable", "service_times").alias("display_service_times"), "service_languages",
        when("kids_displayable", "kids_program").alias("display_kids_program"), "status", "address_displayable", "latitude", "longitude", "profile_ready", "map_ready", "needs_geocode",
    )


#: How a find met a place: what is published comes before the place's shown address, its listed one and the geocoder's.
_MET = ("published_place", "verified_address", "directory_address", "census_match")


def _addresses(df: DataFrame, keys: list[str], ranked: list[tuple[int, str, str]]) -> DataFrame:
    """A row for each address that a row of df has: keys, the address, whether it is a street or the geocoder's, and its rank."""
    kinds = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col(column).alias("address")) for rank, kind, column in ranked])
    return df.select(*keys, F.explode(kinds).alias("a")).select(*keys, "a.*").where("address is not null")


@model
def mart_directory_matches(b: Build) -> DataFrame:
    """New finds that the directory has, or that are published already: the same name key, and one address in common.

    Both sides are long tables of names and addresses, so that one equal join finds whatever address it is that they share.
    """
    key = lambda street, city: F.when(F.col(street).isNotNull(), address_key(F.col(street), F.col(city), F.lit(None).cast("string")))
    pins = b["int_geocodes"].where("pin_usable").select("subject_type", "subject_id", F.col("matched_address").alias("pin"))
    of_finds = pins.where("subject_type = 'candidate'").select(F.col("subject_id").alias("candidate_id"), "pin")
    of_places = pins.where("subject_type = 'place'").select(F.col("subject_id").try_cast("long").alias("place_id"), "pin")
    finds = b["mart_new_places"].join(of_finds, "candidate_id", "left").select("candidate_id", name_key("candidate_name").alias("name"), key("display_street_address", "city").alias("street"), "pin")
    listed = b["dim_place"].join(b["stg_places"].select("place_id", key("street_text", "city").alias("listed_street")), "place_id").join(of_places, "place_id", "left")
    listed = listed.select("place_id", F.explode(F.array_distinct(F.array(name_key("display_name"), name_key("listed_name")))).alias("name"), key("display_street_address", "city").alias("street"), "listed_street", "pin")
    published = b["stg_published"].join(of_finds, "candidate_id", "left").select("place_id", F.col("candidate_id").alias("itself"), name_key("published_name").alias("name"), key("published_street", "city").alias("street"), "pin")
    there = _addresses(listed.withColumn("itself", F.lit(None).cast("string")), ["place_id", "itself", "name"], [(1, "street", "street"), (2, "street", "listed_street"), (3, "pin", "pin")])
    there = there.union(_addresses(published, ["place_id", "itself", "name"], [(0, "street", "street"), (0, "pin", "pin")]))
    met = _addresses(finds, ["candidate_id", "name"], [(0, "street", "street"), (0, "pin", "pin")]).drop("rank").join(there, ["name", "kind", "address"])
    best = met.where(differs(F.col("itself"), F.col("candidate_id"))).groupBy("candidate_id", "place_id").agg(F.min("rank").alias("rank"))
    return best.select("candidate_id", "place_id", F.get(F.array(*[F.lit(x) for x in _MET]), F.col("rank")).alias("matched_on"))


@model
def mart_publish_places(b: Build) -> DataFrame:
    """What is written for places of the directory; null writes nothing."""
    m = b["stg_results"].select("place_id", "pin_check", "address_source_url", "phone_source_url", "service_source_url", "kids_source_url", "phone_source_type", "service_source_type", "kids_source_type")
    d = b["dim_place"].join(m, "place_id", "left")
    inside = F.col("scope_status").isin("in_scope", "in_scope_labeled")
    moves = (F.col("pin_check") == "off") & F.col("proposed_pin_usable") & (F.col("proposed_pin_moves_m") > 50)
    given = lambda value, column: F.when(inside & F.col(value).isNotNull(), F.col(column))
    out = d.select(
        "place_id", F.nullif("scope_status", F.lit("in_scope")).alias("scope_status"), "display_tradition", given("display_street_address", "display_street_address").alias("address"), F.when(inside, F.col("display_zip")).alias("zip_code"),
        given("display_street_address", "address_source_url").alias("address_source_url"), given("display_street_address", "address_source_type").alias("address_source_type"), given("display_phone", "display_phone").alias("phone"),
        given("display_phone", "phone_source_url").alias("phone_source_url"), given("display_phone", "phone_source_type").alias("phone_source_type"), given("display_service_times", "display_service_times").alias("service_times"),
        given("display_service_times", "service_languages").alias("service_languages"), given("display_service_times", "service_source_url").alias("service_source_url"), given("display_service_times", "service_source_type").alias("service_source_type"),
        given("display_kids_program", "display_kids_program").alias("kids_program"), given("display_kids_program", "kids_source_url").alias("kids_source_url"), given("display_kids_program", "kids_source_type").alias("kids_source_type"),
        F.when(inside, F.col("verified_website")).alias("website"), F.when(inside, F.col("facebook_page_url")).alias("facebook_url"), F.when(inside & moves, F.col("proposed_latitude")).alias("latitude"), F.when(inside & moves, F.col("proposed_longitude")).alias("longitude"), "checked_at",
    )
    return out.where(F.coalesce("scope_status", "address", "phone", "service_times", "kids_program", "website", "facebook_url").isNotNull() | F.col("latitude").isNotNull())


@model
def mart_publish_new(b: Build) -> DataFrame:
    """Finds that go on the map."""
    c = b["stg_candidates"].select("candidate_id", "denomination_stated", "address_source_url", "address_source_type", "phone_source_url", "phone_source_type", "service_source_url", "service_source_type", "kids_source_url", "kids_source_type", "status_source_url", "status_source_type", "checked_at")
    n = b["mart_new_places"].where("map_ready").join(c, "candidate_id")
    given = lambda value, column: F.when(F.col(value).isNotNull(), F.col(column)).alias(column)
    return n.select(
        F.col("candidate_id").alias("external_id"), F.col("candidate_name").alias("name"), F.col("denomination_stated").alias("denomination"), F.col("display_street_address").alias("address"), "city", F.lit("CA").alias("state"), F.col("display_zip").alias("zip_code"),
        "latitude", "longitude", "address_source_url", "address_source_type", F.col("display_phone").alias("phone"), given("display_phone", "phone_source_url"), given("display_phone", "phone_source_type"), F.col("display_service_times").alias("service_times"),
        given("display_service_times", "service_languages"), given("display_service_times", "service_source_url"), given("display_service_times", "service_source_type"), F.col("display_kids_program").alias("kids_program"), given("display_kids_program", "kids_source_url"),
        given("display_kids_program", "kids_source_type"), F.col("verified_website").alias("website"), F.col("facebook_page_url").alias("facebook_url"), "status_source_url", "status_source_type", "checked_at",
    )


@model
def mart_published_standing(b: Build) -> DataFrame:
    """Where the candidate of each published find stands now."""
    c = b["int_candidate_readiness"].select("candidate_id", F.lit(True).alias("candidate_found"), "is_new_place", "map_ready")
    p = b["stg_published"].join(c, "candidate_id", "left")
    status = F.when(F.col("candidate_found").isNull(), "unknown_candidate").when(~F.col("is_new_place"), "no_longer_new").when(~F.col("map_ready"), "no_longer_map_ready").otherwise("current")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return p.select("place_id", "candidate_id", "published_name", flag("candidate_found"), flag("is_new_place"), flag("map_ready"), status.alias("publication_status"))


@model
def mart_quality_audit(b: Build) -> DataFrame:
    """A3, A4, M7: the blind audit by field, and over all."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    counts = [F.count(F.lit(1)).alias("reviewed"), *[count(v).alias(v) for v in ("agree", "disagree", "definition_disagreement", "needs_review")], F.round(F.try_divide(count("agree"), F.count(F.lit(1))), 3).alias("agreement_rate"), F.countDistinct("place_id").alias("places")]
    return rolled_up(b["quality_reviews"], "field", counts)


def _more_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each row that a relation has more or less than what it is made from."""
    n = lambda df, sign: df.agg((sign * F.count(F.lit(1))).alias("n"))
    off = n(before, 1).unionAll(n(after, -1)).agg(F.abs(F.sum("n")).alias("off"))
    return off.where("off > 0").select(F.explode(F.sequence(F.lit(1), F.col("off"))).alias("row"))


# Assertions (Q3): each gives the rows that break it.


#: The lettered rounds, passes and tasks; work packages are known by their pattern.
KNOWN_BATCHES = ("A_calibration", "B_main", "C_main", "D_main", "F_main")
KNOWN_PASSES = ("A", "A_redo", "A_fbcheck", "B", "FB1", "E", "C", "D", "F", "H")
KNOWN_TASKS = ("A", "B", "CN", "C", "D", "E", "F", "L", "H")
PACKAGE = "^WP[0-9]{4}$"
_SHOWN = ("address", "phone", "service", "kids")


def _any(conditions: list[Column]) -> Column:
    return F.exists(F.array(*conditions), lambda x: F.coalesce(x, F.lit(False)))


def assertions(b: Build) -> dict[str, DataFrame]:
    """What must be empty after every build."""
    r, c, p, n, m = b["int_place_readiness"], b["int_candidate_readiness"], b["mart_publish_places"], b["mart_publish_new"], b["stg_results"]
    of = lambda df, condition, key: df.where(condition).select(F.col(key).cast("string").alias("subject"))
    both = lambda condition: of(r, condition, "place_id").unionAll(of(c, condition, "candidate_id"))
    stale_page = _any([F.col(f"{f}_displayable") & (F.col(f"{f}_source_type") == "fb_page") & ~(F.col("verified_active") & F.col("fb_page_fresh")) for f in _SHOWN])
    not_found = _any([F.col(f"{f}_displayable") & (F.col(f"{f}_source_type") != "fb_page") & ~F.col(f"{f}_source_verified") for f in _SHOWN])
    unknown = lambda df, column, known: df.where(~F.col(column).isin(*known) & ~F.col(column).rlike(PACKAGE)).select(F.col(column).alias("subject"))
    values = {"address": "street_address", "phone": "phone", "service": "service_times"}
    unsourced = [of(m, F.col(v).isNotNull() & (F.col(f"{f}_source_url").isNull() | F.col(f"{f}_source_type").isNull()), "place_id") for f, v in values.items()]
    written = {"address": "address", "phone": "phone", "service": "service_times", "kids": "kids_program"}
    unlinked = [of(df, F.col(v).isNotNull() & F.col(f"{f}_source_url").isNull(), key) for df, key in ((p, "place_id"), (n, "external_id")) for f, v in written.items()]
    withheld = m.join(b["dim_place"].select("place_id", "display_phone"), "place_id").where("personal_phone_withheld and (phone is not null or display_phone is not null)")
    union = lambda parts: reduce(DataFrame.unionAll, parts)
    return {
        "candidate_duplicates_are_not_new": c.where("is_new_place and duplicate_of_place_id is not null").select("candidate_id"),
        "page_facts_are_fresh": both(stale_page),
        "hidden_is_never_visit_ready": r.where("not is_in_scope and visit_ready").select("place_id"),
        "map_ready_has_a_current_pin": c.where("map_ready and (not pin_usable or latitude is null or longitude is null)").select("candidate_id"),
        "visit_ready_is_where_they_meet": r.where("visit_ready and coalesce(address_is_worship_location, '') <> 'yes'").select("place_id"),
        "holds_win": r.where("(hold_address and address_displayable) or (hold_service and service_displayable)").select("place_id"),
        "one_result_for_each_manifest_place": b["manifest"].select("place_id").distinct().join(b["results"].groupBy("place_id").agg(F.count(F.lit(1)).alias("n")), "place_id", "left").where("coalesce(n, 0) <> 1").select("place_id"),
        "no_shared_pin_across_addresses": b["stg_geocodes"].where("geocode_status = 'ok'").groupBy("latitude", "longitude").agg(F.countDistinct(address_key(F.col("geocoded_street"), F.col("geocoded_city"), F.lit(None).cast("string"))).alias("n")).where("n > 1").select("latitude"),
        "new_places_are_not_in_the_directory": b["mart_directory_matches"].select("candidate_id"),
        "published_facts_have_a_source": union(unlinked),
        "usable_pins_are_inside_the_envelope": b["int_geocodes"].where(F.col("pin_usable") & ~geo.in_envelope(F.col("latitude"), F.col("longitude"))).select("subject_id"),
        "joins_add_no_rows": _more_rows(b["stg_places"], b["dim_place"]).unionAll(_more_rows(b["stg_candidates"], c)),
        "no_page_address_as_website": p.where(F.contains(F.lower("website"), F.lit("facebook.com"))).select("place_id"),
        "finds_are_not_in_the_directory": b["stg_places"].where("source = 'found'").select("place_id"),
        "labels_are_known": union([unknown(m, "batch", KNOWN_BATCHES), unknown(m, "last_pass", KNOWN_PASSES), unknown(b["stg_candidates"], "task", KNOWN_TASKS)]),
        "no_personal_phone_is_kept": of(withheld, F.lit(True), "place_id").unionAll(of(b["stg_candidates"], F.expr("personal_phone_withheld and phone is not null"), "candidate_id")),
        "shown_facts_were_found_again": both(not_found),
        "street_name_alone_is_not_routable": r.where("has_routable_directory_address and not has_house_number and not has_google_address").select("place_id"),
        "researched_facts_have_a_source": union(unsourced),
    }
