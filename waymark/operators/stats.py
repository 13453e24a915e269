"""Counts and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """M6: per cent with one decimal, null of nothing."""
    return F.when(whole != 0, F.round(100.0 * part / whole, 1))


def ratio(part: Column, whole: Column, places: int = 3) -> Column:
    """M7: a share, null of nothing."""
    return F.round(F.try_divide(part, whole), places)


def conditional_counts(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """A1, A2: rows and the rows that meet each condition, by key or over all, in one pass."""
    counts = [F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def rolled_up(df: DataFrame, key: str, aggregates: Sequence[Column], label: str = "all") -> DataFrame:
    """A3: by key and over all; the row over all has the label, and so has a null key."""
    return df.rollup(key).agg(*aggregates).withColumn(key, F.coalesce(key, F.lit(label)))


def status_bucket(column: Column | str, buckets: Sequence[tuple[str, str]], default: str) -> Column:
    """The bucket of the first prefix that fits."""
    out = F.lit(default)
    for prefix, bucket in reversed(buckets):
        out = F.when(F.startswith(column, F.lit(prefix)), F.lit(bucket)).otherwise(out)
    return out


def filled_buckets(df: DataFrame, column: str, buckets: Sequence[str]) -> DataFrame:
    """A row for each bucket, those without rows too, with count and per cent of all."""
    spark = df.sparkSession
    table = spark.createDataFrame([(b, i) for i, b in enumerate(buckets)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return F.broadcast(table).join(counts, column, "left").crossJoin(F.broadcast(total)).select(column, "place", F.coalesce("n", F.lit(0)).alias("n"), percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("pct"))


def stage_health(runs: DataFrame, now: Column, budgets: dict[str, int], window_days: int = 7) -> DataFrame:
    """By stage, the last success, the last run that got something done, runs of the window, and whether the age exceeds its budget of seconds.

    runs: stage, started_at, status, rows_ok. A stage without progress is stale.
    """
    grouped = runs.groupBy("stage").agg(
        F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_success"),
        F.max(F.when(F.col("rows_ok") > 0, F.col("started_at"))).alias("last_progress"),
        F.count_if(F.col("started_at") >= now - F.expr(f"INTERVAL {window_days} DAYS")).alias("recent_runs"),
        F.count_if((F.col("status") == "error") & (F.col("started_at") >= now - F.expr(f"INTERVAL {window_days} DAYS"))).alias("recent_errors"),
    )
    budget = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    age = F.timestamp_diff("SECOND", F.col("last_progress"), now)
    return grouped.withColumn("age_seconds", age).withColumn("is_stale", F.coalesce(F.col("age_seconds") > F.try_element_at(budget, F.col("stage")), F.lit(True)))


def with_overlapping_scopes(df: DataFrame, membership: DataFrame, key: str, scope: str, everything: str) -> DataFrame:
    """Every row once under the scope of all, and again under each scope that it belongs to. Never add up over scopes."""
    return df.withColumn(scope, F.lit(everything)).unionByName(df.join(membership.select(key, scope), key))


def shared_values(df: DataFrame, keys: Sequence[str], more_than: int) -> DataFrame:
    """Rows whose keys more than so many rows share, with their number; grouped before the join back."""
    dense = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sharing")).where(F.col("sharing") > more_than)
    return df.join(dense, list(keys))


def counted_by(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows by key, most first; keys decide ties."""
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.asc_nulls_last(n) for n in keys])


def field_precision(results: DataFrame) -> DataFrame:
    """By field, how many were judged and the share of right ones. results: field, ok."""
    return results.where("ok is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("precision"))


def regressions(now: DataFrame, baseline: DataFrame, allowed: float, allowed_for: dict[str, float]) -> DataFrame:
    """Q13: fields whose precision fell by more than is allowed. Both: field, precision."""
    limit = F.lit(allowed)
    for name, x in allowed_for.items():
        limit = F.when(F.col("field") == name, F.lit(x)).otherwise(limit)
    both = now.select("field", F.col("precision").alias("now")).join(baseline.select("field", F.col("precision").alias("before")), "field")
    return both.withColumn("drop", F.round(F.col("before") - F.col("now"), 4)).where(F.col("drop") > limit)


def bounds(df: DataFrame, key: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """By group, the mean place and the box."""
    return df.groupBy(key).agg(F.avg(lat).alias("mid_lat"), F.avg(lon).alias("mid_lon"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order; a sort within groups, so rows of one key are one task's."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W2 without a sort: the row with the greatest values of the order columns, pre-aggregated before the shuffle, so a key with very many rows is no burden."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children; children are counted before the join."""
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
