"""Queries of text rules, labels and small relational steps, each over whole tables (survey 2.2, 2.3, 2.6-2.8, 2.10, 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, labels, text, udfs
from waymark.operators import matching, merging, publishing, quality, search, stats
from waymark.queries.registry import FIXTURES, Tables, query

_GROUPS = ("address", "kids", "phone", "service", "status")


def _case(key: str, values: list[str | None]) -> str:
    """SQL for one of the values by a number."""
    arms = " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


FIXTURES.update({
    "named": "SELECT c_custkey AS place_id, "
    + _case("c_custkey", ["Iglesia Nueva Vida", "Korean Hope", "Grace Hall", "First Chinese Church", "Viet Hope", "African Hope", "Mount Zion", "AME Chapel", "Tamil Fellowship", "African Methodist Hall", "Hmong Alliance", "Casa Brasil", "Zenith Church"])
    + " AS name, "
    + _case("c_custkey", ["Baptist", "Zen Buddhist", None, "Messianic Jewish", "christian science", "Islam", "", "Unitarian Universalist", "Frozen Yogurt", "Church of Scientology", "The Jain Center"])
    + " AS denomination FROM {customer}",
    "tax_file": "SELECT s_suppkey AS ein, "
    + _case("s_suppkey", ["GRACE CHURCH", "TEMPLE BETH EL", "KOREAN BAPTIST CHURCH SCHOOL", "IGLESIA DE DIOS", "ZEN CENTER", "YOUTH RADIO", "CALVARY CHAPEL"])
    + " AS name, "
    + _case("s_suppkey", ["P.O. BOX 12", "12 MAIN ST", "POST OFFICE BOX 7", "9 OAK AVE STE 4", "40 ELM RD # 2"])
    + " AS street, "
    + _case("s_suppkey", ["03", "03", "03", "04"]) + " AS subsection, " + _case("s_suppkey", ["10", "15"]) + " AS foundation, " + _case("s_suppkey", ["X20", "X30", "", "A11", "X21Z", "X70"]) + " AS ntee, " + _case("s_suppkey", ["001000", "029", None]) + " AS activity FROM {supplier}",
    "spoken": "SELECT c_custkey AS place_id, " + _case("c_custkey", ["Mandarin; English", "english and korean", "國語/粵語、English", "tagalog, filipino;farsi", " ", None, "Spanish,,Spanish", "brandy and Español"]) + " AS languages FROM {customer}",
    "streets": "SELECT c_custkey AS place_id, CAST(c_custkey % 300 AS STRING) || ' ' || "
    + _case("c_custkey", ["north main street", "Sixth Avenue, Suite 4", "Oak Rd #12", "Southwest Seventeenth Pl (rear)", "El Camino Real Bldg C", "O'Farrell St.", "stevens creek highway unit 9"])
    + " AS street FROM {customer}",
    "stated": "SELECT c_custkey AS place_id, c_custkey * 10 AS weight"
    + "".join(f", CASE WHEN (c_custkey + {k}) % 3 <> 0 THEN 'http://{g}.org/' || CAST(c_custkey AS STRING) ELSE ' ' END AS {g}_source_url, CASE WHEN (c_custkey + {k}) % 5 <> 0 THEN '{g} ' || CAST(c_custkey % 9 AS STRING) END AS {g}_excerpt" for k, g in enumerate(_GROUPS))
    + " FROM {customer}",
})

#: RE2 has no lookahead: the same two rules in its words.
_RE2 = {
    labels.CULTURES[12][0]: r"\bame\b|african methodist episcopal|national baptist|progressive national|national missionary baptist|colored methodist|c\.m\.e\.|mount zion\b|\bame zion\b",
    labels.CULTURES[13][0]: r"\bswahili\b|\bafrican\b\s*([^m\s]|m[^e]|$)",
}
_FIRST = ["CASE " + " ".join(f"WHEN regexp_matches(x, '(?i){_RE2.get(p, p)}') THEN '{c[k]}'" for p, *c in labels.CULTURES) + " END" for k in (0, 1)]


@query(f"SELECT place_id, {_FIRST[0]} AS language, {_FIRST[1]} AS culture FROM (SELECT place_id, name || ' ' || coalesce(denomination, '') AS x FROM {{named}})")
def culture_by_name(t: Tables) -> DataFrame:
    """Language and culture by the first rule that fits."""
    return t.named.select("place_id", labels.culture(F.col("name"), F.col("denomination")).alias("c")).select("place_id", "c.language", "c.culture")


@query("""
SELECT place_id, d LIKE '%messianic%' OR d LIKE '%jews for jesus%' OR d LIKE '%hebrew christian%' OR NOT regexp_matches(d, '(^|[^a-z])(""" + "|".join(labels.OUT_OF_SCOPE) + """)') AS in_scope
FROM (SELECT place_id, lower(coalesce(denomination, '')) AS d FROM {named})""")
def churches_in_scope(t: Tables) -> DataFrame:
    """Whether a denomination is in scope, by the starts of its words."""
    return t.named.select("place_id", labels.in_scope("denomination").alias("in_scope"))


_TOLD = ["service_times", "summary", "kids_program", "service_languages"]
_TAGS = ["service_languages", "worship_style", "programs", "theological_stance", "statement_of_faith"]


@query(
    "SELECT place_id, coalesce(n, 0) > 0"
    + "".join(f" OR coalesce(trim({c}) <> '', false)" for c in _TOLD)
    + "".join(f" OR coalesce(trim(json_extract_string(CASE WHEN json_valid(tags) THEN tags END, '$.{c}')) NOT IN ('', '[]', 'false', '0'), false)" for c in _TAGS)
    + " AS recommendable FROM {places} LEFT JOIN (SELECT place_id, count(*) AS n FROM {reviews} GROUP BY place_id) USING (place_id)"
)
def recommendable(t: Tables) -> DataFrame:
    """Places with reviews or anything else to show."""
    told = labels.says_something(*_TOLD, *[F.get_json_object("tags", f"$.{c}") for c in _TAGS])
    counted = t.reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    return t.places.join(counted, "place_id", "left").select("place_id", ((F.coalesce("n", F.lit(0)) > 0) | told).alias("recommendable"))


@query(rf"""
SELECT ein, regexp_matches(replace(upper(street), '.', ''), '{labels.MAILBOX}|{labels.UNIT}') AS mailbox, regexp_matches(name, '{labels.GATHERING_WORDS}') AND NOT regexp_matches(name, '{labels.AGENCY_WORDS}') AS gathering
FROM {{tax_file}} WHERE subsection = '03' AND (foundation = '10' OR ntee LIKE 'X2%' OR coalesce(activity LIKE '001%', false)) AND left(ntee, 3) NOT IN ('X30', 'X40', 'X50', 'X70') AND NOT regexp_matches(name, '{labels.OTHER_WORDS}')""")
def tax_rows(t: Tables) -> DataFrame:
    """A tax file's rows of interest, with flags."""
    c = F.col
    rows = t.tax_file.where(labels.is_charity_of_interest(c("subsection"), c("foundation"), c("ntee"), c("activity"), c("name")))
    return rows.select("ein", labels.is_mailbox(c("street")).alias("mailbox"), labels.is_gathering(c("name")).alias("gathering"))


@query(" UNION ALL ".join(f"SELECT place_id, '{g}' AS field, trim({g}_source_url) AS source_url, {g}_excerpt AS excerpt FROM {{stated}} WHERE trim({g}_source_url) <> '' AND trim({g}_excerpt) <> ''" for g in _GROUPS))
def fact_rows(t: Tables) -> DataFrame:
    """A row for each group of facts that has a source and an excerpt."""
    return publishing.facts(t.stated, "place_id", _GROUPS)


@query("SELECT place_id, field, row_number() OVER (PARTITION BY place_id ORDER BY field) AS nth FROM (" + " UNION ALL ".join(f"SELECT place_id, '{g}' AS field FROM {{stated}} WHERE trim({g}_source_url) <> '' AND trim({g}_excerpt) <> ''" for g in _GROUPS) + ")")
def fact_sources_in_order(t: Tables) -> DataFrame:
    """A place's facts in the order of their names; a place has five at most."""
    from pyspark.sql import Window

    return publishing.facts(t.stated, "place_id", _GROUPS).select("place_id", "field", F.row_number().over(Window.partitionBy("place_id").orderBy("field")).alias("nth"))


def _map(values: dict[str, str]) -> str:
    return "MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}}"


@query(rf"""
WITH l AS (SELECT place_id, list_transform(list_filter(list_transform(string_split_regex(coalesce(languages, ''), '[;,/、]|\band\b'), lambda p: trim(p)), lambda p: p <> ''), lambda p: coalesce({_map(text.LANGUAGE_NAMES)}[lower(p)], upper(p[1]) || p[2:])) AS l FROM {{spoken}})
SELECT place_id, array_to_string(list_filter(l, lambda p, k: list_position(l, p) = k), ';') AS languages FROM l""")
def spoken_languages(t: Tables) -> DataFrame:
    """Lists of languages under the names that are kept."""
    return t.spoken.select("place_id", text.language_list("languages").alias("languages"))


@query(rf"""
SELECT place_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(upper(street), '(,|#|\(|\b(SUITE|STE|BLDG|BUILDING|APT|UNIT)\b).*$', ''), '[A-Z0-9]+'), lambda w: coalesce({_map(text.STREET_WORDS)}[w], w)), ' ') AS street FROM {{streets}}""")
def postal_streets(t: Tables) -> DataFrame:
    """Streets in the postal short form, without units."""
    return t.streets.select("place_id", text.postal_street("street").alias("street"))


@query("SELECT place_id, array_to_string(list_transform(regexp_extract_all(lower(street), '([a-z]+|[^a-z]+)'), lambda w: upper(w[1]) || w[2:]), '') AS titled, left(street, 10) AS head FROM {streets}")
def title_cased(t: Tables) -> DataFrame:
    """A capital for each run of letters, and the first characters."""
    return t.streets.select("place_id", labels.title_case("street").alias("titled"), F.left("street", F.lit(10)).alias("head"))


@query()
def street_statements(t: Tables) -> DataFrame:
    """Street keys, and whether a sentence states the street (T12, T13). The tests hold the rules to written cases."""
    said = F.concat(F.lit("Visit us at "), "street", F.lit(" on Sunday"))
    return t.streets.select("place_id", udfs.street_key_of("street").alias("street_key"), udfs.supports_street(said, F.col("street")).alias("stated"), udfs.supports_street(F.concat(F.lit("1"), "street"), F.col("street")).alias("stated_by_longer_number"))


@query("SELECT s_suppkey FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE lower(c.c_mktsegment) = lower(s.s_name) AND c.c_nationkey = s.s_nationkey) AND NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey * 3 = s.s_suppkey)")
def absent_records(t: Tables) -> DataFrame:
    """Records whose name key and id aren't known yet."""
    known = t.customer.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("city"), (F.col("c_custkey") * 3).alias("external_id"))
    new = t.supplier.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("city"), F.col("s_suppkey").alias("external_id"))
    return matching.absent(new, known, ["name", "city"], "external_id").select("s_suppkey")


@query("SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_runs(t: Tables) -> DataFrame:
    """The last runs (O12): a top-k report."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "ts")


@query("SELECT place_id, coalesce(n, 0) AS programs FROM {places} LEFT JOIN (SELECT place_id, count(*) AS n FROM {programs} GROUP BY place_id) USING (place_id)")
def program_counts(t: Tables) -> DataFrame:
    """How many programs each place has, none included."""
    return stats.child_counts(t.places.select("place_id"), t.programs, "place_id", "programs")


@query("SELECT review_id FROM {reviews} WHERE NOT (place_id IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) AND rating = 1)")
def without_fixtures(t: Tables) -> DataFrame:
    """Rows that stay after a deletion of those with a listed key that still look as expected."""
    listed = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("place_id"))
    return merging.without_listed(t.reviews, listed, "place_id", F.col("rating") == 1).select("review_id")


@query("""
SELECT place_id, '{{' || array_to_string(list_filter(['"id":' || place_id, '"city":"' || city || '"', CASE WHEN phone IS NOT NULL THEN '"phone":"' || phone || '"' END, CASE WHEN website IS NOT NULL THEN '"website":"' || website || '"' END], lambda p: p IS NOT NULL), ',') || '}}' AS profile FROM {places}""")
def profile_json(t: Tables) -> DataFrame:
    """A JSON object of each place without its absent keys."""
    return t.places.select("place_id", F.to_json(F.struct(F.col("place_id").alias("id"), "city", "phone", "website")).alias("profile"))


@query("""
SELECT place_id FROM (SELECT place_id, coalesce(trim(summary) <> '', false) AS told, coalesce(n, 0) AS n FROM {places} LEFT JOIN (SELECT place_id, count(*) AS n FROM {reviews} GROUP BY place_id) USING (place_id)) ORDER BY told DESC, n DESC, place_id LIMIT 30""")
def useful_first(t: Tables) -> DataFrame:
    """Places that were read first, then the most reviewed, ties as they came (O17): a top-k report."""
    counted = stats.child_counts(t.places.select("place_id", labels.says_something("summary").alias("told")), t.reviews, "place_id", "n")
    return search.best(counted, [F.desc("told"), F.desc("n"), F.asc("place_id")], 30).select("place_id")


@query("SELECT place_id, address_source_url, address_excerpt, CAST(s.weight AS BIGINT) AS weight, n FROM {places} LEFT JOIN {stated} s USING (place_id) LEFT JOIN (SELECT place_id, count(*) AS n FROM {reviews} GROUP BY place_id) USING (place_id)")
def with_evidence(t: Tables) -> DataFrame:
    """Rows with their evidence and counts, by two left joins."""
    counted = t.reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    out = publishing.with_evidence(t.places.select("place_id"), [t.stated.select("place_id", "address_source_url", "address_excerpt", F.col("weight").cast("long").alias("weight")), counted], "place_id")
    return out.select("place_id", "address_source_url", "address_excerpt", "weight", "n")


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'orphan' WHEN a.v <> b.v THEN 'stale' ELSE 'fresh' END AS state
FROM (SELECT c_custkey AS k, c_nationkey % 3 AS v FROM {customer}) a FULL JOIN (SELECT o_custkey + 7 AS k, max(o_orderkey) % 3 AS v FROM {orders} GROUP BY o_custkey) b ON a.k = b.k""")
def cache_states(t: Tables) -> DataFrame:
    """Cached results against what they should be made from: missing, orphan, stale or fresh (Q14)."""
    wanted = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 3).alias("version"))
    kept = t.orders.groupBy((F.col("o_custkey") + 7).alias("k")).agg((F.max("o_orderkey") % 3).alias("version"))
    return quality.cache_states(wanted, kept, "k", "version")


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM {embeddings} WHERE vec_id = 0)), 6) AS cosine FROM {embeddings}")
def cosine_to_one(t: Tables) -> DataFrame:
    """The cosine of every vector with one of them."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    one = vectors.where("vec_id = 0").limit(1).select(F.col("embedding").alias("other"))
    both = vectors.join(F.broadcast(one), how="left")  # one row
    return both.select("vec_id", F.round(geo.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
