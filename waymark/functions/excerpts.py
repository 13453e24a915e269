"""Whether a page says what an excerpt quotes, by column expressions.

Both are put into the same plain form first: words of letters and numbers, a space between. The excerpt is read as a whole, in
its parts and in finer parts; each reading is an array of parts, and a fold over it counts those that the page has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.udfs import normalized

#: Where an excerpt is joined from parts, roughly and finely; words of a note about a page instead of a quotation; lengths.
JOINTS = r"\s+(?:\.\.\.|…|/|\|)\s+|…|\s\.\.\.\s?"
FINE_JOINTS = r"\s+[—–+·]\s+|\s*[;；]\s+|\s\|\s"
ABOUT_A_PAGE = r"(?i)\b(homepage carries|site footer|own-site date|images? dated|no dated content|current-date content|fetched page|within 12 months|fellowship post)\b"
SHORT_PART, NEAR, CAPPED = 6, 300, 190

#: Signs that the normal form would change, but that joints are told by (the first three) or must not be told by.
_KEPT, _AS = "…—–／｜＋．", "\ue000\ue001\ue002\ue003\ue003\ue003\ue003"
_ROUGH, _FINE = (joint.translate(str.maketrans(_KEPT, _AS)) for joint in (JOINTS, FINE_JOINTS))

#: A number, or a word without digits.
WORD = r"\p{Nd}+|[\p{L}\p{Nl}\p{No}]+"


def spaced(text: Column) -> Column:
    """T4: the words of a normalized text in lower case, a space between; 9am is 9 am."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " ")


def squashed(words: Column) -> Column:
    """T4: spaced() words without spaces but those between two digits, so numbers don't grow together."""
    return F.regexp_replace(words, r"(?<!\p{Nd}) | (?!\p{Nd})", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: within a lambda Spark computes it anew at each place where it is written."""
    return F.transform(F.array(value), use)[0]


def _whole(said: Column, inner: str) -> Column:
    """A pattern of words that may not go on with these characters at an end that is one of them; null without words."""
    left = F.when(said.rlike(f"^[{inner}]"), f"(?<![{inner}])").otherwise("")
    right = F.when(said.rlike(f"[{inner}]$"), f"(?![{inner}])").otherwise("")
    return F.when(said != "", F.concat(left, said, right))


def _uncut(said: Column) -> Column:
    """Words without a last and a first one of letters, which a limit on the length may have cut; three stay."""

    def ends(words: Column) -> Column:
        return F.when((F.size(words) > 3) & F.element_at(words, -1).rlike(r"^\p{L}+$"), F.slice(words, 1, F.size(words) - 1)).otherwise(words)

    def both(words: Column) -> Column:
        return F.when((F.size(words) > 3) & words[0].rlike(r"^\p{L}+$"), F.slice(words, 2, F.size(words) - 1)).otherwise(words)

    return F.array_join(_once(_once(F.split(said, " "), ends), both), " ")


def _split(parts: Column, joint: str) -> Column:
    return F.filter(F.transform(F.flatten(F.transform(parts, lambda p: F.split(p, joint))), lambda p: F.trim(p)), lambda p: p != "")


def _place(plain: Column, part: Column) -> Column:
    """The place (from 1) of a part's first match; null without any. The pattern is tried only where its words are, which is soon seen."""
    return F.when(F.contains(plain, part["said"]), _once(F.regexp_instr(plain, part["pattern"]), lambda at: F.when(at > 0, at)))


def _near(plain: Column, part: Column, after: Column) -> Column:
    """The place of the first match within NEAR characters of a place, of a part whose first match at all is known.

    What stands before the looked-at part is told by one character: a capital, which no plain text has, if a word goes on there.
    """
    low = F.greatest(after - NEAR, F.lit(1))
    lead = F.when((low > 1) & F.substring(plain, low - 1, F.lit(1)).rlike("[A-Za-z0-9]"), "Z").otherwise("\n")
    # Beyond the last place at which a match may begin, as much follows as a part is long.
    looked = F.concat(lead, F.substring(plain, low, after + NEAR - low + 1 + 2 * F.length(part["pattern"])))
    later = _once(_once(looked, lambda near: _place(near, part)) - 2 + low, lambda at: F.when((at >= low) & (at <= after + NEAR), at))
    return F.when(part["place"] >= low, F.when(part["place"] <= after + NEAR, part["place"])).otherwise(later)


def _told(parts: Column, capped: Column, plain: Column) -> Column:
    """Of each part the form that is looked for, whole or uncut, and its first place in the plain text; whether it is short; its form in the dense text."""
    n = F.size(parts)

    def form(said: Column) -> Column:
        return F.struct(said.alias("said"), _whole(said, "A-Za-z0-9").alias("pattern"))

    def placed(part: Column) -> Column:
        return F.struct(part["said"].alias("said"), part["pattern"].alias("pattern"), _place(plain, part).alias("place"))

    def told(part: Column, said: Column, k: Column) -> Column:
        single = F.size(_split(_split(F.array(part), _ROUGH), _FINE)) <= 1
        # Of a part that stands whole somewhere the uncut form isn't tried.
        uncut = F.when(capped & ((k == 0) | (k == n - 1)), _once(_once(_uncut(said), form), placed))
        found = _once(_once(_once(said, form), placed), lambda whole: F.when(whole["place"].isNull(), F.coalesce(uncut, whole)).otherwise(whole))
        short = F.length(F.replace(said, F.lit(" "))) < SHORT_PART

        def both(f: Column, short: Column) -> Column:
            return F.struct(f["said"], f["pattern"], f["place"], short.alias("short"), F.when(f["place"].isNull() & ~short & single & (said != ""), said).alias("dense"))

        return _once(found, lambda f: _once(short, lambda short: both(f, short)))

    return F.transform(parts, lambda part, k: _once(spaced(part), lambda said: told(part, said, k)))


def _unspaced(words: Column) -> Column:
    return F.replace(words, F.lit(" "))


def _found(parts: Column, plain: Column, dense: Column) -> Column:
    """How many parts the page has, and how many of them exactly; dense is null if no part is there even without spaces."""

    def one(state: Column, part: Column) -> Column:
        # A short part must stand near the one before.
        near = F.when(part["short"] & part["place"].isNotNull() & state["place"].isNotNull(), _near(plain, part, state["place"])).otherwise(part["place"])
        loose = F.when(part["dense"].isNull() | dense.isNull(), False).otherwise(F.regexp_like(dense, _once(squashed(part["dense"]), lambda said: _whole(said, "0-9"))))
        return _once(F.struct(near.alias("at"), loose.alias("loose")), lambda f: F.struct(
            F.when(~f["loose"], F.coalesce(f["at"], state["place"])).cast("int").alias("place"),
            (state["found"] + (f["at"].isNotNull() | f["loose"]).cast("int")).alias("found"), (state["exact"] + f["at"].isNotNull().cast("int")).alias("exact"),
        ))

    return F.aggregate(parts, F.struct(F.lit(None).cast("int").alias("place"), F.lit(0).alias("found"), F.lit(0).alias("exact")), one)


def with_excerpt_verdict(df: DataFrame, excerpt: str, page: str, name: str = "verdict") -> DataFrame:
    """Df with a struct of verdict, found (parts on the page), total (parts) and mode (exact, loose or empty). No shuffle.

    Of the three readings the first with the largest share of parts found counts: verified if all are. Words and numbers
    match whole. A part of fewer than SHORT_PART letters must stand within NEAR characters of the part before. A longer
    one that has no finer parts may also match without spaces, numbers whole (loose). An excerpt about as long as the limit may
    have a cut word at either end. A note about the page that doesn't match is not_an_excerpt, else what has some parts is
    partial and what has none not_found. Null texts count as empty.
    """
    quoted = F.coalesce(excerpt, F.lit(""))
    # The normal form changes no words of these characters alone.
    other = (F.octet_length("_text") != F.char_length("_text")) & F.col("_text").rlike(r"[^\x00-\x7f\u00c0-\u00ff]")
    rows = df.withColumns({"_text": F.coalesce(page, F.lit("")), "_excerpt": F.translate(quoted, _KEPT, _AS)})
    rows = rows.withColumn("_other", F.when(other, F.col("_text")))
    rows = rows.withColumns({"_quoted": normalized("_excerpt"), "_page": normalized("_other")})
    rows = rows.withColumn("_plain", spaced(F.when(F.col("_other").isNull(), F.col("_text")).otherwise(F.col("_page"))))
    whole = F.array("_quoted")
    rows = rows.withColumn("_rough", _split(whole, _ROUGH)).withColumn("_fine", _split(F.col("_rough"), _FINE))
    # A reading that is as an earlier one, or has no parts and falls back to the whole, is left out: the earlier one is taken of equals.
    readings = [whole, *[F.when((F.size(p) > 0) & (F.col(p) != before), F.col(p)) for p, before in (("_rough", whole), ("_fine", F.col("_rough")))]]
    plain = F.col("_plain")
    rows = rows.withColumns({f"_r{k}": _told(p, F.length(quoted) >= CAPPED, plain) for k, p in enumerate(readings)})
    # The dense text is made only where a part stands without any spaces.
    rows = rows.withColumn("_packed", _unspaced(plain))
    run_together = [F.exists(f"_r{k}", lambda part: F.contains(F.col("_packed"), _unspaced(part["dense"]))) for k in range(3)]
    rows = rows.withColumn("_dense", F.when(F.array_contains(F.array(*run_together), True), squashed(plain)))
    rows = rows.withColumns({f"_f{k}": _found(F.col(f"_r{k}"), plain, F.col("_dense")) for k in range(3)})
    best = F.array_max(F.array(*[F.when(F.col(f"_f{k}").isNotNull(), F.struct((F.col(f"_f{k}.found") / F.size(f"_r{k}")).alias("share"), F.lit(-k).alias("order"), F.col(f"_f{k}.found").alias("found"), F.col(f"_f{k}.exact").alias("exact"), F.size(f"_r{k}").alias("total"))) for k in range(3)]))
    rows = rows.withColumn("_best", best)
    b = lambda c: F.col(f"_best.{c}")
    verdict = F.when(b("found") == b("total"), "verified").when(quoted.rlike(ABOUT_A_PAGE), "not_an_excerpt").when(b("found") > 0, "partial").otherwise("not_found")
    mode = F.when(b("found") == 0, "").when(b("exact") == b("found"), "exact").otherwise("loose")
    return rows.select(*df.columns, F.struct(verdict.alias("verdict"), b("found").alias("found"), b("total").alias("total"), mode.alias("mode")).alias(name))
