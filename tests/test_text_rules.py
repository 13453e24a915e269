"""Text rules by written cases: excerpts, streets, labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waymark.functions import excerpts, labels, udfs


EXCERPTS = [
    ("9402 Main", "We meet at 19402 Main Street", ("not_found", 0, 1, "")),
    ("9402 Main", "We meet at 9402 Main Street", ("verified", 1, 1, "exact")),
    ("9 am", "At 9 amen", ("not_found", 0, 1, "")),
    ("Sunday worship 9am", "SUNDAY worship, 9 AM", ("verified", 1, 1, "exact")),
    ("Sunday worship / 9 am", "Sunday worship at 11 am", ("partial", 1, 2, "exact")),
    ("Sunday worship / 9 am", "Sunday worship at 9 am", ("verified", 2, 2, "exact")),
    ("Sunday worship / 9 am", "Sunday worship " + "word " * 100 + "9 am", ("partial", 1, 2, "exact")),
    ("Sunday worship / 9 am", "9 am " + "word " * 100 + "Sunday worship, x9 am. 9 amen, at 9 am", ("verified", 2, 2, "exact")),
    ("Sunday worship", "Sun day wor ship", ("verified", 1, 1, "loose")),
    ("The site footer has 2019", "Welcome", ("not_an_excerpt", 0, 1, "")),
    ("", "Welcome", ("not_found", 0, 1, "")),
    (None, None, ("not_found", 0, 1, "")),
    (" … ", "Welcome", ("not_found", 0, 1, "")),
    ("Sun day worship", "Sunday worship", ("verified", 1, 1, "loose")),
    ("call 5528 1430 today", "call 55281430 today", ("not_found", 0, 1, "")),
    ("ome " + "one two three " * 14 + "welc", "Welcome home " + "one two three " * 14 + "welcome", ("verified", 1, 1, "exact")),
    ("a" * 5 + " longer words — other words", "other words. longer words", ("partial", 1, 2, "exact")),
    ("ﬁrst ﬂoor … ２４ rooms", "First floor with 24 rooms", ("verified", 2, 2, "exact")),
    ("主日崇拜 … 團契聚會時間", "歡迎參加主日崇拜及團契聚會時間", ("verified", 2, 2, "exact")),
    ("one two three four; five six seven", "five six seven, then one two three four", ("verified", 2, 2, "exact")),
    ("welcome / to be / us all", "welcome " + "x " * 120 + "to be " + "y " * 200 + " us all", ("partial", 2, 3, "exact")),
]


def test_excerpts(spark):
    rows = spark.createDataFrame([(k, e, p) for k, (e, p, _) in enumerate(EXCERPTS)], "id int, excerpt string, page string")
    found = {r["id"]: tuple(r["v"]) for r in excerpts.with_excerpt_verdict(rows, "excerpt", "page", "v").collect()}
    assert [(*e, found[k]) for k, e in enumerate(EXCERPTS) if found[k] != e[2]] == []


def test_excerpts_of_other_characters(spark):
    """Pages that skip the normal form, and those that must not; words within words; short parts whose first match is far off."""
    far = "amen " + "word " * 90
    cases = [
        ("NAÏVE café", "a naïve, CAFÉ", ("verified", 1, 1, "exact")),
        ("cafe", "café cafeé", ("verified", 1, 1, "exact")),
        ("m² plan", "60 m2 plan", ("verified", 1, 1, "exact")),
        ("worship \u2026 am", far + "worship amen am", ("verified", 2, 2, "exact")),
        ("worship \u2026 am", far + "worship xam amx", ("partial", 1, 2, "exact")),
        ("worship \u2026 am", "am " + far + "worship, then am", ("verified", 2, 2, "exact")),
        ("sunday school", "ﬁrst Sun\u00a0day school", ("verified", 1, 1, "loose")),
        ("1 2 evening song", "evening 1 2eveningsong", ("verified", 1, 1, "loose")),
        ("hymn 12 song", "hymn12songs and hymn 123song", ("verified", 1, 1, "loose")),
    ]
    rows = spark.createDataFrame([(k, e, p) for k, (e, p, _) in enumerate(cases)], "id int, excerpt string, page string")
    found = {r["id"]: tuple(r["v"]) for r in excerpts.with_excerpt_verdict(rows, "excerpt", "page", "v").collect()}
    assert [(*e, found[k]) for k, e in enumerate(cases) if found[k] != e[2]] == []


def test_excerpt_work_is_written_once(spark):
    """Within a lambda Spark shares no work: each expression that is written twice is computed twice (over 300 word lists a row before)."""
    rows = spark.createDataFrame([("a", "b")], "excerpt string, page string")
    plan = excerpts.with_excerpt_verdict(rows, "excerpt", "page", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 8
    assert plan.count("regexp_instr(") <= 24


@pytest.mark.parametrize(
    ("street", "key"),
    [
        ("12 Main Street, Suite 4", "12 main st"),
        ("Twenty-One Oak Avenue", "21 oak ave"),
        ("One Hundred Five North 39th St.", "105 n 39 st"),
        ("592A Tennent Ave", "592a tennent ave"),
        ("7 Saint Lawrence Way Court", "7 st lawrence way"),
        ("9 Court Street", "9 ct st"),
        ("3 Elm #2", "3 elm"),
        ("Main Street", None),
        ("12", None),
        ("", None),
        (None, None),
    ],
)
def test_street_key(street, key):
    assert udfs.street_key(street) == key


@pytest.mark.parametrize(
    ("excerpt", "street", "stated"),
    [
        ("Find us at 107 San Pedro, Colma", "107 San Pedro Road", True),
        ("107 San Pedro Avenue", "107 San Pedro Road", False),
        ("107 San Mateo Avenue", "107 San Pedro Road", False),
        ("1107 San Pedro Road", "107 San Pedro Road", False),
        ("at one oak st", "1 Oak Street", True),
        ("twenty one Oak Street", "1 Oak Street", False),
        (None, "1 Oak Street", False),
        ("1 Oak Street", None, False),
    ],
)
def test_states_street(excerpt, street, stated):
    assert udfs.states_street(excerpt, street) is stated


def test_labels(spark):
    rows = spark.createDataFrame([("AME Zion Lutheran Hall", "Messianic Jewish"), ("African Methodist Union", "Christian Science"), ("Señor Jesús", "zen"), (None, None)], "name string, denomination string")
    found = rows.select(labels.culture(F.col("name"), F.col("denomination")).culture.alias("c"), labels.in_scope("denomination").alias("s")).collect()
    assert [(r["c"], r["s"]) for r in found] == [("African American", True), (None, True), ("Hispanic/Latino", False), (None, True)]
    told = spark.createDataFrame([("o'fallon 2nd ST",), (None,)], "x string").select(labels.title_case("x").alias("t"), labels.either_holds(F.col("x"), F.lit("FALLON")).alias("h"), labels.any_of(F.col("x"), ["zz", "2ND"]).alias("a")).collect()
    assert [tuple(r) for r in told] == [("O'Fallon 2Nd St", True, True), (None, False, False)]
