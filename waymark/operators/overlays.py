"""Answers that overlay returned records, with the guards under which they hold (B5), and facts that cite a stale source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.stats import latest_by


def asked_address(street: Column, city: Column) -> Column:
    """Street and city as a question was about them: case and spacing aside."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.concat(plain(street), F.lit("|"), plain(city))


def proven_answers(answers: DataFrame, checks: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of answers (keys, file_no, fingerprint and more) the newest of each subject that holds, with asked, the address it was asked about.

    An answer holds if its question is known (asked: keys, file_no, street_address, city) and its excerpt was verified with the
    same fingerprint (checks: keys, file_no, verdict, fingerprint). One that doesn't leaves an earlier one in place.
    """
    on = [*keys, "file_no"]
    question = asked.select(*on, asked_address(F.col("street_address"), F.col("city")).alias("asked")).dropDuplicates(on)
    verified = checks.where("verdict = 'verified'").select(*on, F.col("fingerprint")).dropDuplicates([*on, "fingerprint"])
    return latest_by(answers.join(question, on).join(verified, [*on, "fingerprint"], "left_semi"), keys, ["file_no"])


def overlaid(records: DataFrame, services: DataFrame, places: DataFrame, keys: Sequence[str], service_columns: Sequence[str]) -> DataFrame:
    """The newest record of each subject (by pass_no) with the answers that overlay it, and who owns what.

    services: keys, file_no and the service columns; the newest file's answer replaces them all, blank ones too. places: keys,
    file_no, asked (see proven_answers), is_worship, worship_street, worship_city, worship_zip, source_url, excerpt. It holds if
    the record's address still is the one that it was asked about, else the subject is to be asked again (ask_again). A no
    with an address in its place is a yes for that address, which then is the record's with the answer as its source. A newer
    record takes everything back and is overlaid anew. Adds service_owner and address_owner, the files that answers are from.
    """
    base = latest_by(records, keys, ["pass_no"])
    s = latest_by(services, keys, ["file_no"]).select(*keys, F.col("file_no").alias("service_owner"), *[F.coalesce(c, F.lit("")).alias(f"_s_{c}") for c in service_columns])
    w = places.select(*keys, F.struct("file_no", "asked", F.lower(F.trim("is_worship")).alias("answer"), *["worship_street", "worship_city", "worship_zip", "source_url", "excerpt"]).alias("w"))
    rows = base.join(s, list(keys), "left").join(w, list(keys), "left")
    said = lambda c: F.nullif(F.col(f"w.{c}"), F.lit(""))
    stale = F.col("w").isNotNull() & (F.col("w.asked") != asked_address(F.col("street_address"), F.col("city")))
    rows = rows.withColumn("ask_again", stale).withColumn("w", F.when(~stale, F.col("w")))
    moved = said("worship_street").isNotNull()
    answer = F.when(moved & (F.col("w.answer") == "no"), "yes").otherwise(F.col("w.answer"))
    new = {
        "is_worship": F.when(answer.isin("yes", "no", "unknown"), answer).otherwise(F.col("is_worship")),
        "street_address": F.when(moved, said("worship_street")).otherwise(F.col("street_address")),
        "city": F.when(moved, F.coalesce(said("worship_city"), "city")).otherwise(F.col("city")),
        "zip": F.when(moved, F.coalesce(said("worship_zip"), "zip")).otherwise(F.col("zip")),
        "address_source_url": F.when(moved, F.coalesce("w.source_url", F.lit(""))).otherwise(F.col("address_source_url")),
        "address_excerpt": F.when(moved, F.coalesce("w.excerpt", F.lit(""))).otherwise(F.col("address_excerpt")),
        **{c: F.when(F.col("service_owner").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in service_columns},
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in records.columns], "service_owner", F.when(moved, F.col("w.file_no")).alias("address_owner"), "ask_again")


def without_stale(facts: DataFrame, stale: DataFrame, key: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Facts whose group still cites the source that is known to be stale (stale: key, field, source_url) become blank, with what belongs to them."""
    wide = stale.groupBy(key).agg(*[F.collect_set(F.when(F.col("field") == g, F.col("source_url"))).alias(f"_stale_{g}") for g in groups])
    rows = facts.join(wide, key, "left")
    cites = {g: F.coalesce(F.array_contains(f"_stale_{g}", F.trim(f"{g}_source_url")), F.lit(False)) for g in groups}
    owner = {c: g for g, columns in groups.items() for c in columns}
    return rows.select(*[F.when(cites[owner[c]], F.lit("")).otherwise(F.col(c)).alias(c) if c in owner else F.col(c) for c in facts.columns])
