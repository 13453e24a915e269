"""Tests that return the rows that break them, validation, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import in_envelope


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Q1, Q2: keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Q1: rows without a value."""
    return df.where(F.col(column).isNull())


def unexpected(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Q1: values outside a set, with their number."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Q1: rows whose parent isn't there."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def findings(df: DataFrame, where: Column, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Q4: a row (level, place, message) for each rule (level, condition, message) that a row breaks."""
    found = [F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(level).alias("level"), where.cast("string").alias("place"), F.lit(message).alias("message"))) for level, condition, message in rules]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


def stamp_problem(column: str, received: Column) -> Column:
    """What is wrong with a time in text: form, or in the future of its receipt; null if nothing."""
    form = F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:\d{2})$")
    at = F.try_to_timestamp(F.col(column))
    return F.when(F.col(column).isNull(), "missing").when(~form | at.isNull(), "malformed").when(at > received, "after_receipt")


def classified_geocodes(rows: DataFrame) -> DataFrame:
    """Status ok, needs_review or failed for each answer of a geocoder.

    rows: geo_id, match (Match, No_Match, Tie), match_type, latitude, longitude, address, same_house (boolean). A point
    that two or more different addresses share is withheld for all of them.
    """
    shared = rows.where("match = 'Match'").groupBy("latitude", "longitude").agg(F.countDistinct(F.lower(F.btrim("address"))).alias("_n")).where("_n > 1").select("latitude", "longitude", F.lit(True).alias("_shared"))
    out = rows.join(shared, ["latitude", "longitude"], "left")
    status = (
        F.when(F.col("match") == "No_Match", "failed").when(F.col("match") == "Tie", "needs_review").when(~in_envelope(F.col("latitude"), F.col("longitude")), "failed")
        .when(F.coalesce("_shared", F.lit(False)), "needs_review").when(~F.coalesce("same_house", F.lit(False)), "needs_review").when(F.col("match_type") == "Exact", "ok").otherwise("needs_review")
    )
    return out.withColumn("status", status).drop("_shared")


def kept_programs(candidates: DataFrame, tests: Sequence[tuple[str, Column]], key: str, identity: Sequence[str], most: int) -> DataFrame:
    """Q12: candidates with the first test they fail as drop_reason; of those that pass, repeats and what exceeds the cap are dropped too."""
    from pyspark.sql import Window

    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests])
    out = candidates.withColumn("_reason", reason)
    passed = F.col("_reason").isNull()
    nth = F.row_number().over(Window.partitionBy(key, *identity, passed).orderBy("position"))
    out = out.withColumn("_reason", F.when(passed & (nth > 1), "repeated").otherwise(F.col("_reason")))
    rank = F.sum(F.col("_reason").isNull().cast("int")).over(Window.partitionBy(key).orderBy("position"))
    return out.withColumn("drop_reason", F.when(F.col("_reason").isNull() & (rank > most), "over_cap").otherwise(F.col("_reason"))).drop("_reason")


def returned_once(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Q15: keys that are missing, unexpected or repeated in what came back."""
    a = expected.groupBy(key).agg(F.count(F.lit(1)).alias("_e"))
    b = received.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    problem = F.when(F.col("_r").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_r") > 1, "repeated")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def table_digest(df: DataFrame) -> DataFrame:
    """S3: one row, the number of rows and a digest that doesn't depend on their order; repeated rows count."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def snapshot_problems(previous: DataFrame, current: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Why a snapshot is refused. Both one row: scope, taken_at, rows."""
    both = previous.select(F.col("scope").alias("s0"), F.col("taken_at").alias("t0"), F.col("rows").alias("n0")).crossJoin(current.select("scope", "taken_at", "rows"))
    tests = {"scope_changed": ~F.col("s0").eqNullSafe(F.col("scope")), "older": F.col("taken_at") <= F.col("t0"), "too_few_rows": F.col("rows") < least_share * F.col("n0")}
    return both.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).alias("problem"))


def copy_matches(source_rows: Column, target_rows: Column, exact_up_to: int = 1000, tolerance: float = 0.001) -> Column:
    """Small copies have the same number of rows, large ones nearly."""
    return F.when(source_rows <= exact_up_to, source_rows == target_rows).otherwise(F.abs(source_rows - target_rows) <= tolerance * source_rows)


def all_succeeded(nodes: DataFrame) -> DataFrame:
    """Q18: one row, whether every node of a run succeeded and there is one."""
    return nodes.agg((F.coalesce(F.bool_and(F.col("status") == "success"), F.lit(False))).alias("complete"))


def cache_states(wanted: DataFrame, kept: DataFrame, key: str, version: str) -> DataFrame:
    """Q14: each key's cached result: missing, orphan, stale (made from another version) or fresh."""
    a = wanted.select(key, F.struct(version).alias("_wanted"))
    b = kept.select(key, F.struct(version).alias("_kept"))
    state = F.when(F.col("_kept").isNull(), "missing").when(F.col("_wanted").isNull(), "orphan").when(F.col(f"_wanted.{version}").eqNullSafe(F.col(f"_kept.{version}")), "fresh").otherwise("stale")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
