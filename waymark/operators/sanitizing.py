"""Returned rows made fit to publish, a reason for each field that goes (Q5), and copies with coercion of types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import udfs
from waymark.functions.text import language_list
from waymark.operators import schedules

#: How a number is told to be a person's own, and how that is denied; a time in an excerpt; a strict stamp.
PERSONAL = r"(?i)\b(cell|mobile|personal|rector's|pastor's|priest's|father's)\b"
NOT_PERSONAL = r"(?i)\bnot (identified as |labell?ed as |a )?personal\b"
WITHHELD = "personal number withheld"
STATED_TIME = r"(?i)\d{1,2}(:\d{2})?\s*(a\.?m\.?|p\.?m\.?|am|pm|點|点|時|时|시)|noon|\d{1,2}:\d{2}|[一二三四五六七八九十]{1,3}\s*(時|时|點|点)|\b\d{1,2}(:\d{2})?\s?[ap]\b"
STRICT_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?Z$"
#: More rows of a file than this with one stamp were stamped when they were written.
BULK = 10


def _text(column: str) -> Column:
    return F.coalesce(column, F.lit(""))


def sanitized(rows: DataFrame, key: str, bad_stamps: Sequence[str] = ()) -> DataFrame:
    """Q5: the rows with what may not be published blanked, and `reasons`, sorted.

    rows: key (each once), file, received_at, notes, phone, phone_source_url, phone_source_type, phone_excerpt, checked_at, service_times, service_excerpt,
    service_languages, street_address, address_excerpt, address_is_worship_location; stamps are texts. Goes: a phone that the
    notes or its excerpt call a person's own (personal_phone); a stamp that is listed, not strict, later than the file
    came, or shared by over BULK rows of its file (unreliable_stamp); times that their excerpt doesn't state
    (unsupported_times); a street that its excerpt doesn't state (unsupported_address). Languages get their kept names.
    """
    told = F.regexp_replace(F.concat_ws(" ", _text("notes"), _text("phone_excerpt")), NOT_PERSONAL, "")
    personal = ((_text("phone") != "") & told.rlike(PERSONAL)) | F.contains(F.lower(_text("notes")), F.lit(WITHHELD))
    bulk = rows.where(_text("checked_at") != "").groupBy("file", "checked_at").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BULK).select("file", "checked_at", F.lit(True).alias("_bulk"))
    stamp = _text("checked_at")
    off = stamp.isin(*bad_stamps) if bad_stamps else F.lit(False)
    unreliable = off | F.coalesce("_bulk", F.lit(False)) | ((stamp != "") & ~stamp.rlike(STRICT_STAMP)) | ((_text("received_at") != "") & (stamp > _text("received_at")))
    timed = rows.where((_text("service_times") != "") & (_text("service_excerpt") != "")).select(key, "service_excerpt", "service_times")
    stated = schedules.supported(timed, key, "service_excerpt", "service_times").withColumnRenamed("supported", "_stated")
    out = rows.join(bulk, ["file", "checked_at"], "left").join(stated, key, "left")
    unsupported = (_text("service_times") != "") & (_text("service_excerpt") != "") & ~(F.col("service_excerpt").rlike(STATED_TIME) & F.coalesce("_stated", F.lit(False)))
    flags = {"personal_phone": personal, "unreliable_stamp": unreliable, "unsupported_times": unsupported, "unsupported_address": (_text("street_address") != "") & ~F.coalesce("_street", F.lit(False))}
    out = out.withColumn("_street", udfs.supports_street(F.col("address_excerpt"), F.col("street_address")))
    out = out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in sorted(flags.items())])))
    goes = {"phone": "personal_phone", "phone_source_url": "personal_phone", "phone_source_type": "personal_phone", "checked_at": "unreliable_stamp", "service_times": "unsupported_times", "street_address": "unsupported_address"}
    worship = F.lower(F.trim(_text("address_is_worship_location")))
    made = {
        **{c: F.when(F.array_contains("reasons", reason), "").otherwise(F.col(c)) for c, reason in goes.items()},
        "address_is_worship_location": F.when(worship == "true", "yes").when(worship == "false", "no").otherwise(worship), "service_languages": language_list("service_languages"),
    }
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns], "reasons")


def coerced(rows: DataFrame, json_columns: Sequence[str] = (), time_columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows whose texts are JSON and times as they should be, with blanks as null and times as timestamps; and the others with `problems`.

    A row is in one of both; the others keep their texts, so nothing is lost in a copy.
    """
    blank = lambda c: F.btrim(_text(c), F.lit(" \t\r\n")) == ""
    tests = [F.when(~blank(c) & F.expr(f"try_parse_json(`{c}`)").isNull(), F.lit(f"{c}: not JSON")) for c in json_columns]
    tests += [F.when(~blank(c) & F.col(c).try_cast("timestamp").isNull(), F.lit(f"{c}: not a time")) for c in time_columns]
    told = rows.withColumn("problems", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))
    made = {**{c: F.when(~blank(c), F.col(c)) for c in json_columns}, **{c: F.when(~blank(c), F.col(c)).try_cast("timestamp") for c in time_columns}}
    good = told.where(F.size("problems") == 0).select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns])
    return good, told.where(F.size("problems") > 0)


def copied(rows: DataFrame, target: str, rejects: str, json_columns: Sequence[str] = (), time_columns: Sequence[str] = ()) -> tuple[int, int]:
    """Writes a copy and, beside it, the rows that can't be copied; how many of each."""
    spark = rows.sparkSession
    for part, path in zip(coerced(rows, json_columns, time_columns), (target, rejects), strict=True):
        part.write.mode("overwrite").parquet(path)
    return spark.read.parquet(target).count(), spark.read.parquet(rejects).count()
