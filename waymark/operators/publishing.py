"""Plans of changes, the gate before them, applying and reverting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import METRES_ROUND, great_circle
from waymark.functions.text import same_value


def long_form(df: DataFrame, key: str, fields: Sequence[str], value: str) -> DataFrame:
    """A row for each field of each row: key, field, value."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields])).alias("_f")).select(key, "_f.*")


def plan(current: DataFrame, desired: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The fields that desired changes: key, field, action (fill, replace or insert), old_value, new_value.

    A blank desired value changes nothing, nor does one that means the same; a Facebook page is no website.
    """
    new = long_form(desired, key, fields, "new_value").where("btrim(coalesce(new_value, '')) <> ''")
    new = new.where(~((F.col("field") == "website") & F.lower("new_value").contains("facebook.com")))
    old = long_form(current, key, fields, "old_value").withColumn("_there", F.lit(True))
    both = new.join(old, [key, "field"], "left")
    same = F.lit(False)
    for f in fields:
        same = F.when(F.col("field") == f, same_value(f, F.col("old_value"), F.col("new_value"))).otherwise(same)
    blank = F.btrim(F.coalesce("old_value", F.lit(""))) == ""
    action = F.when(F.col("_there").isNull(), "insert").when(blank, "fill").when(~F.coalesce(same, F.lit(False)), "replace")
    return both.withColumn("action", action).where("action is not null").select(key, "field", "action", "old_value", "new_value")


def applied(current: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The state after a plan; what isn't named in the plan stays."""
    wide = changes.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("new_value"))).alias(f"_new_{f}") for f in fields])
    kinds = dict(current.dtypes)
    out = current.join(wide, key, "full_outer")
    return out.select(*[F.coalesce(F.col(f"_new_{c}").cast(kinds[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def reverted(state: DataFrame, log: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The state before a run: each changed field gets the oldest old value of the run's log, inserted rows go. log: id, key, field, action, old_value."""
    first = log.groupBy(key, "field").agg(F.min_by(F.struct("old_value"), "id").alias("_old"))
    inserted = log.where("action = 'insert'").select(key).distinct()
    wide = first.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("_old"))).alias(f"_old_{f}") for f in fields])
    kinds = dict(state.dtypes)
    out = state.join(inserted, key, "left_anti").join(wide, key, "left")
    return out.select(*[F.when(F.col(f"_old_{c}").isNotNull(), F.col(f"_old_{c}.old_value").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns])


def reverted_since(log: DataFrame, key: str) -> DataFrame:
    """Keys whose last publication was followed by a revert. log: id, key, action."""
    last = log.groupBy(key).agg(F.max(F.when(F.col("action") != "revert", F.col("id"))).alias("_p"), F.max(F.when(F.col("action") == "revert", F.col("id"))).alias("_r"))
    return last.where(F.col("_r") > F.coalesce("_p", F.lit(-1))).select(key)


def same_local_day(a: Column, b: Column, zone: str = "America/Los_Angeles") -> Column:
    """Whether two times (UTC) are on one day in a zone."""
    return F.to_date(F.from_utc_timestamp(a, zone)) == F.to_date(F.from_utc_timestamp(b, zone))


def gate(rows: DataFrame, key: str, reverted_keys: DataFrame, most_metres: float = 50.0, most_rows: int = 200) -> DataFrame:
    """Q11: why each row of a publication needs a person: reasons, and auto where there is none.

    rows: key, address, verified (boolean), latitude, longitude, old_latitude, old_longitude. Reasons: not_verified,
    shared_address (of two keys or more), moved_far, was_reverted; too_many_rows on all if more than `most_rows` would
    go by themselves. Shared addresses are counted by address first, so a very common one is no task's burden.
    """
    shared = rows.where("address is not null").groupBy("address").agg(F.countDistinct(key).alias("_keys")).where("_keys > 1").select("address", F.lit(True).alias("_shared"))
    again = reverted_keys.select(key).distinct().withColumn("_reverted", F.lit(True))
    moved = great_circle(F.col("latitude"), F.col("longitude"), F.col("old_latitude"), F.col("old_longitude"), METRES_ROUND)
    tests = {"not_verified": ~F.coalesce("verified", F.lit(False)), "shared_address": F.coalesce("_shared", F.lit(False)), "moved_far": F.coalesce(moved > most_metres, F.lit(False)), "was_reverted": F.coalesce("_reverted", F.lit(False))}
    out = rows.join(shared, "address", "left").join(again, key, "left")
    out = out.select(key, F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()])).alias("reasons"))
    veto = out.agg((F.count_if(F.size("reasons") == 0) > most_rows).alias("_veto"))
    out = out.crossJoin(F.broadcast(veto)).withColumn("reasons", F.when(F.col("_veto"), F.concat("reasons", F.array(F.lit("too_many_rows")))).otherwise(F.col("reasons")))
    return out.select(key, F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("auto"))


def reason_counts(gated: DataFrame, names: Sequence[str]) -> DataFrame:
    """How many rows each reason holds back, those that hold back none too."""
    table = gated.sparkSession.createDataFrame([(n,) for n in names], "reason string")
    counts = gated.withColumn("reason", F.explode(F.split("reasons", ","))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(table).join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def audit_worksheet(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers (place_id, field, value) beside the recorded value, graded agree, disagree or needs_review; blank answers aren't."""
    both = answers.where("btrim(coalesce(value, '')) <> ''").join(truth.select("place_id", "field", F.col("value").alias("recorded")), ["place_id", "field"])
    same = F.lit(None).cast("boolean")
    for f in ("phone", "website", "latitude", "longitude"):
        same = F.when(F.col("field") == f, same_value(f, F.col("value"), F.col("recorded"))).otherwise(same)
    same = F.when(F.col("field").isin("phone", "website", "latitude", "longitude"), same).otherwise(same_value("text", F.col("value"), F.col("recorded")))
    return both.withColumn("verdict", F.when(same.isNull(), "needs_review").when(same, "agree").otherwise("disagree"))


def facts(df: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """a row for each group of facts of a row that has both a source and an excerpt: key, field, source_url, excerpt."""
    each = F.array(*[F.struct(F.lit(g).alias("field"), F.btrim(f"{g}_source_url").alias("source_url"), F.col(f"{g}_excerpt").alias("excerpt")) for g in groups])
    return df.select(key, F.explode(each).alias("_f")).select(key, "_f.*").where("source_url <> '' and btrim(excerpt) <> ''")


def with_evidence(rows: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows with the columns of each part, which has a key once; rows without evidence stay."""
    for part in parts:
        rows = rows.join(part, key, "left")
    return rows
