"""Ranked search over a directory of places.

places: place_id, name, city, state, latitude, longitude, scope_status, summary, service_times, service_languages (; list),
kids_program, tags (JSON object). reviews: place_id, rating and further ratings. programs: place_id, program_type, age_bands.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, jsonx
from waymark.functions.text import contains_folded, same_folded

#: Statuses that are shown besides none, and bands a family can ask for, youngest first.
SHOWN, BANDS = ("in_scope", "in_scope_labeled"), ("preschool", "children", "youth")
KIDS_WORDS = r"(?i)\b(kids?|child|children'?s?|youth|nursery|sunday school|vbs|vacation bible school)\b"


def visible() -> Column:
    """without a status, or with one that is shown."""
    return F.col("scope_status").isNull() | F.col("scope_status").isin(*SHOWN)


def tag_filters(language: str | None = None, worship_style: str | None = None, stance: str | None = None) -> Column:
    """F16: the optional conditions on a place's tags, all of which must hold."""
    parts = []
    if language:
        parts.append(F.array_contains(F.transform(jsonx.strings("tags", "service_languages"), F.lower), language.lower()))
    if worship_style:
        parts.append(jsonx.folded_equal("tags", "worship_style", worship_style))
    if stance:
        parts.append(jsonx.folded_equal("tags", "theological_stance", stance))
    return reduce(Column.__and__, parts, F.lit(True))


def with_reviews(places: DataFrame, reviews: DataFrame, averages: Sequence[str] = ("rating",)) -> DataFrame:
    """Places with review_count and avg_<column>; reviews are aggregated before the join, so it is one row to one."""
    sums = reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("review_count"), *[F.avg(c).alias(f"avg_{c}") for c in averages])
    return places.join(sums, "place_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def _points(*parts: tuple[Column, float]) -> Column:
    return reduce(Column.__add__, [F.when(F.coalesce(condition, F.lit(False)), F.lit(points)).otherwise(F.lit(0 * points)) for condition, points in parts])


def profile_score() -> Column:
    """M8: how much a newcomer can learn about a place before a first visit, 0 to 11."""
    filled = lambda c: F.btrim(F.coalesce(F.col(c), F.lit(""))) != ""
    stated = lambda key: F.coalesce(jsonx.at("tags", key), F.lit("")) != ""
    return _points(
        (F.col("review_count") > 0, 3), (filled("service_times"), 2), (filled("summary"), 2), (jsonx.filled_array("tags", "service_languages"), 1),
        (stated("worship_style"), 1), (jsonx.filled_array("tags", "programs"), 1), (stated("theological_stance") | jsonx.filled_array("tags", "statement_of_faith"), 1),
    )


@dataclass(frozen=True)
class Preferences:
    """What a visitor asks for; kids=True stands for all bands."""

    languages: Sequence[str] = ()
    worship: Sequence[str] = ()
    kids: bool | Sequence[str] = ()
    weekday_care: bool = False

    @property
    def bands(self) -> list[str]:
        return list(BANDS) if self.kids is True else [b for b in BANDS if b in (self.kids or ())]


def program_flags(programs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """By place: a program of an asked-for band, one without stated ages, weekday care that fits."""
    fits, open_to = jsonx.overlaps("age_bands", bands) if bands else F.lit(False), F.coalesce(F.size("age_bands") == 0, F.lit(False))
    care = (F.col("program_type") == "weekday_care") & (F.lit(not bands) | open_to | fits)
    return programs.groupBy("place_id").agg(F.bool_or(fits).alias("has_band"), F.bool_or(open_to).alias("has_open"), F.bool_or(care).alias("has_care"))


def fit_score(wanted: Preferences) -> Column:
    """M9: evidence for what is wanted, 0 to 4: a point each, half a point for a kids program of unstated ages. Needs program_flags, review_count and avg_childrens_programs."""
    parts: list[Column] = []
    languages = [x.strip().lower() for x in wanted.languages if x.strip()]
    if languages:
        spoken = F.concat(F.coalesce(F.split("service_languages", ";"), F.expr("cast(array() as array<string>)")), jsonx.strings("tags", "service_languages"))
        parts.append(F.when(jsonx.overlaps(F.transform(spoken, lambda x: F.lower(F.btrim(x))), languages), 1.0).otherwise(0.0))
    if wanted.worship:
        parts.append(F.when(jsonx.at("tags", "worship_style").isin(*wanted.worship), 1.0).otherwise(0.0))
    if wanted.bands:
        told = F.exists(jsonx.strings("tags", "programs"), lambda x: x.rlike(KIDS_WORDS))
        rated = (F.col("review_count") >= 3) & (F.col("avg_childrens_programs") > 4.0)
        some = F.coalesce("has_open", F.lit(False)) | (F.btrim(F.coalesce("kids_program", F.lit(""))) != "") | F.coalesce(told, F.lit(False)) | F.coalesce(rated, F.lit(False))
        parts.append(F.when(F.coalesce("has_band", F.lit(False)), 1.0).when(some, 0.5).otherwise(0.0))
    if wanted.weekday_care:
        parts.append(F.when(F.coalesce("has_care", F.lit(False)), 1.0).otherwise(0.0))
    return reduce(Column.__add__, parts, F.lit(0.0))


def city_places(places: DataFrame, city: str, state: str) -> DataFrame:
    """the places of a city."""
    return places.where(same_folded("city", city) & same_folded("state", state))


def city_center(places: DataFrame, city: str, state: str) -> DataFrame:
    """One row, the interpolated medians of the city's visible places on the map; null if there are none."""
    mapped = city_places(places, city, state).where(visible() & geo.bounded(F.col("latitude"), F.col("longitude")))
    return mapped.agg(F.expr("percentile_cont(0.5) within group (order by latitude)").alias("center_lat"), F.expr("percentile_cont(0.5) within group (order by longitude)").alias("center_lon"))


def city_median(places: DataFrame, city: str, state: str) -> DataFrame:
    """A10: one row, the middle latitude and longitude that places of the city have."""
    mapped = city_places(places, city, state).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return mapped.agg(F.expr("percentile_disc(0.5) within group (order by latitude)").alias("median_lat"), F.expr("percentile_disc(0.5) within group (order by longitude)").alias("median_lon"))


@dataclass(frozen=True)
class Request:
    """A search: a city, a name or a circle (latitude, longitude, miles), how to sort, and one page of it (Q16)."""

    city: str | None = None
    state: str | None = None
    name: str | None = None
    near: tuple[float, float, float] | None = None
    origin: tuple[float, float] | None = None
    sort: str = "nearest"
    wanted: Preferences = field(default_factory=Preferences)
    filters: dict = field(default_factory=dict)
    limit: int = 20
    offset: int = 0

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.city, self.name, self.near)) != 1:
            raise ValueError("a search has a city, a name or a circle")
        if (self.city is None) != (self.state is None):
            raise ValueError("a city comes with its state")
        if self.sort not in ("nearest", "for_you"):
            raise ValueError(f"unknown sort {self.sort}")
        if not 1 <= self.limit <= 500 or self.offset < 0:
            raise ValueError("a page has 1 to 500 rows from offset 0 on")
        if self.near is not None and not (-90 <= self.near[0] <= 90 and -180 <= self.near[1] <= 180 and self.near[2] > 0):
            raise ValueError("a circle has a place on earth and a radius")


def search(places: DataFrame, reviews: DataFrame, programs: DataFrame, request: Request) -> DataFrame:
    """One page of a scope, ranked as a whole before the limit, with the scope's size on every row.

    Order (O3, O4): nearest, or fit to what is wanted; then profile, distance, name and id. The scope and filters come
    first and reach the scan; distance, fit and the one-row center are columns of the same plan. The size (W1) is a
    count of its own beside it: a window without partitions would bring the scope to one task.
    """
    scope = visible() & tag_filters(**request.filters)
    if request.near is not None:
        scope &= geo.bounded(F.col("latitude"), F.col("longitude"))
    elif request.name is not None:
        scope &= contains_folded("name", request.name)
    else:
        scope &= same_folded("city", request.city) & same_folded("state", request.state)
    found = with_reviews(places.where(scope), reviews, ("rating", "childrens_programs"))
    found = found.join(program_flags(programs, request.wanted.bands), "place_id", "left")
    origin = request.near[:2] if request.near is not None else request.origin
    if origin is not None:
        found = found.withColumn("distance_miles", geo.great_circle(F.col("latitude"), F.col("longitude"), *origin))
    elif request.city is not None:
        found = found.crossJoin(F.broadcast(city_center(places, request.city, request.state)))  # one row
        found = found.withColumn("distance_miles", geo.great_circle(F.col("latitude"), F.col("longitude"), F.col("center_lat"), F.col("center_lon")))
    else:
        found = found.withColumn("distance_miles", F.lit(None).cast("double"))
    if request.near is not None:
        found = found.where(F.col("distance_miles") <= request.near[2])  # F15
    found = found.select("place_id", "name", "city", "state", "review_count", F.round("avg_rating", 1).alias("avg_rating"), "distance_miles", fit_score(request.wanted).alias("fit_score"), profile_score().alias("profile_score"))
    last = [F.asc("name"), F.asc("place_id")]
    order = {
        "nearest": [F.asc_nulls_last("distance_miles"), F.desc("profile_score"), *last],
        "for_you": [F.desc("fit_score"), F.desc("profile_score"), F.asc_nulls_last("distance_miles"), *last],
    }[request.sort]
    page = found.orderBy(*order).offset(request.offset).limit(request.limit)
    return page.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total_count"))))


def city_list(places: DataFrame, reviews: DataFrame, city: str, state: str, limit: int, order: str = "default") -> DataFrame:
    """O1, O2: a city by what is known of its places: described and reviewed first, or by profile and distance to the middle."""
    found = with_reviews(city_places(places, city, state).where(visible()), reviews)
    if order == "starting_point":
        found = found.crossJoin(F.broadcast(city_median(places, city, state)))
        keys = [F.desc("profile_score"), F.asc_nulls_last("from_middle")]
        found = found.withColumns({"profile_score": profile_score(), "from_middle": geo.planar(F.col("latitude"), F.col("longitude"), F.col("median_lat"), F.col("median_lon"))})
    else:
        keys = [F.desc("described"), F.desc("review_count")]
        found = found.withColumn("described", F.col("summary").isNotNull() | F.col("tags").isNotNull())
    return found.orderBy(*keys, F.asc("name"), F.asc("place_id")).limit(limit)


def by_name(places: DataFrame, reviews: DataFrame, name: str, limit: int, offset: int = 0) -> DataFrame:
    """Places whose name holds a text: equal first, then beginning with it, then profile, reviews and names."""
    found = with_reviews(places.where(visible() & contains_folded("name", name)), reviews)
    tier = F.when(same_folded("name", name), 0).when(F.startswith(F.lower("name"), F.lower(F.lit(name))), 1).otherwise(2)
    found = found.withColumns({"tier": tier, "profile_score": profile_score()})
    return found.orderBy("tier", F.desc("profile_score"), F.desc("review_count"), "name", F.asc_nulls_last("city"), F.asc_nulls_last("state"), "place_id").offset(offset).limit(limit)


def after(df: DataFrame, key: str, last: int, limit: int) -> DataFrame:
    """The next page by key; the condition reaches the scan, so no page costs more than another."""
    return df.where(F.col(key) > last).orderBy(key).limit(limit)


def similar(vectors: DataFrame, target: int, dimensions: Sequence[str], k: int = 3) -> DataFrame:
    """The k places with the smallest squared distance to one place's values; missing values count as zero, ties go to smaller ids."""
    one = vectors.where(F.col("place_id") == target).select(*[F.col(d).alias(f"_t_{d}") for d in dimensions]).limit(1)
    pairs = [(F.col(d), F.col(f"_t_{d}")) for d in dimensions]
    rest = vectors.where(F.col("place_id") != target).crossJoin(F.broadcast(one))
    return rest.withColumn("distance", geo.squared_difference(pairs)).orderBy("distance", "place_id").limit(k).drop(*[f"_t_{d}" for d in dimensions])


def rating_tags(minimum: int = 3) -> Column:
    """What a place's ratings say, from at least `minimum` reviews. Fixed thresholds, in order."""
    rules = (
        ("worship_energy", ">", 4.5, "Vibrant worship"), ("community_warmth", ">", 4.5, "Warm community"), ("sermon_depth", ">", 4.3, "Deep teaching"), ("childrens_programs", ">", 4.0, "Great for kids"),
        ("theological_openness", ">", 4.0, "Open-minded"), ("theological_openness", "<", 2.5, "Traditional"), ("facilities", ">", 4.3, "Great facilities"),
    )
    tag = lambda c, op, x, t: F.when((F.col("review_count") >= minimum) & (F.col(f"avg_{c}") > x if op == ">" else F.col(f"avg_{c}") < x), F.lit(t))
    return F.array_compact(F.array(*[tag(*r) for r in rules]))


def listed_tags(tags: Column | str, keys: Sequence[str], most: int = 200) -> Column:
    """the listed keys of a JSON object that have a value, as a map; a text is cut at a word."""
    from waymark.functions.text import truncate_words

    entries = F.array(*[F.struct(F.lit(k).alias("key"), truncate_words(jsonx.at(tags, k), most).alias("value")) for k in keys])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def best(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows; an order that ends with the input's key keeps ties as they came."""
    return df.orderBy(*order).limit(k)
