"""State and changes to new state: upserts, replacements, corrections, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.stats import latest_by


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Changes with a new key are added, others overwrite the given columns (all, if none are given).

    A null key equals nothing: such rows of either side stay as they are. Changes have each key once.
    """
    rest = [c for c in state.columns if c not in keys]
    columns = rest if columns is None else list(columns)
    whole = lambda df: [F.col(k).isNotNull() for k in keys]
    named = lambda df: df.where(F.forall(F.array(*whole(df)), lambda x: x))
    bare = lambda df: df.where(~F.forall(F.array(*whole(df)), lambda x: x))
    old = named(state).withColumn("_old", F.lit(True)).alias("s")
    new = named(changes).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    value = lambda c: F.when(F.col("_old").isNull() | (F.col("_new") & F.lit(c in columns)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *[value(c) for c in rest]).select(*state.columns).unionByName(bare(state)).unionByName(bare(changes).select(*state.columns))


def add_counts(state: DataFrame, events: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Counters that grow by the events of their key."""
    return state.select(*keys, count).unionByName(events.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))).groupBy(*keys).agg(F.sum(count).alias(count))


def cached(state: DataFrame, fetched: DataFrame, key: str, when: str = "fetched_at") -> DataFrame:
    """For each key the entry that was fetched last."""
    return latest_by(state.unionByName(fetched), [key], [when])


def replace_children(children: DataFrame, new: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Parents whose outcome (key, status) is ok get the new children in place of theirs; others keep what they have."""
    done = outcome.where("status = 'ok'").select(key).distinct()
    return children.join(done, key, "left_anti").unionByName(new.join(done, key, "left_semi").select(*children.columns))


def corrected(state: DataFrame, fixes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fixes (key, column_name, old_value, new_value) that hold where the value still is the old one."""
    wide = fixes.groupBy(key).agg(*[F.max(F.when(F.col("column_name") == c, F.struct("old_value", "new_value"))).alias(f"_fix_{c}") for c in columns])
    out = state.join(wide, key, "left")
    fixed = lambda c: F.when(F.col(f"_fix_{c}").isNotNull() & F.col(f"_fix_{c}.old_value").eqNullSafe(F.col(c)), F.col(f"_fix_{c}.new_value")).otherwise(F.col(c)).alias(c)
    return out.select(*[fixed(c) if c in columns else F.col(c) for c in state.columns])


def numbered(df: DataFrame, file: str, order: Sequence[str]) -> DataFrame:
    """Rows numbered within their file, and the id `<file>-NN`."""
    out = df.withColumn("row_no", F.row_number().over(Window.partitionBy(file).orderBy(*order)))
    return out.withColumn("row_id", F.format_string("%s-%02d", F.col(file), F.col("row_no")))


def union_of_manifests(*manifests: tuple[DataFrame, str, str]) -> DataFrame:
    """Manifests one after another, with a default batch and handling for each."""
    out = None
    for n, (df, batch, handling) in enumerate(manifests):
        part = df.withColumns({"batch": F.coalesce(F.nullif("batch", F.lit("")), F.lit(batch)), "handling": F.coalesce(F.nullif("handling", F.lit("")), F.lit(handling)), "manifest_no": F.lit(n)})
        out = part if out is None else out.unionByName(part)
    return out


def carried_over(checks: DataFrame, history: DataFrame, keys: Sequence[str], transient: Sequence[str], days: int = 30) -> DataFrame:
    """A check that failed for a passing reason keeps the last decisive verdict before it, if that was `verified` and at most so many days old.

    checks and history: keys, verdict, checked_at. Decisive are verdicts that aren't transient. Adds final and carried_over.
    """
    is_transient = F.coalesce(F.col("verdict").isin(*transient), F.lit(False))
    past = history.where(~F.col("verdict").isin(*transient)).where(F.col("checked_at").isNotNull())
    past = past.select(*keys, F.struct("checked_at", "verdict").alias("_past"), F.col("checked_at").alias("_at"), F.col("verdict").alias("_v"))
    timeline = checks.where(is_transient).withColumn("_at", F.col("checked_at")).withColumn("_is_check", F.lit(True)).unionByName(past, allowMissingColumns=True)
    # One pass over a key's times: of a time's rows the history comes first, its largest verdict last.
    before = Window.partitionBy(*keys).orderBy("_at", F.coalesce("_is_check", F.lit(False)), "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = timeline.withColumn("_last", F.last("_past", ignorenulls=True).over(before)).where("_is_check")
    holds = (F.col("_last.verdict") == "verified") & (F.col("checked_at") <= F.col("_last.checked_at") + F.expr(f"INTERVAL {days} DAYS"))
    for key in keys:
        holds = holds & F.col(key).isNotNull()
    holds = F.coalesce(holds, F.lit(False))
    kept = checks.where(~is_transient).select(*checks.columns, F.col("verdict").alias("final"), F.lit(False).alias("carried_over"))
    return kept.unionByName(failed.select(*checks.columns, F.when(holds, F.lit("verified")).otherwise(F.col("verdict")).alias("final"), holds.alias("carried_over")))


def attached_verdicts(facts: DataFrame, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest verdict of each fact; `stale` if the fact has changed since, `unchecked` without one. Both: keys, fingerprint."""
    newest = latest_by(checks, keys, ["checked_at"]).select(*keys, F.col("fingerprint").alias("_fp"), F.col("verdict").alias("_v"))
    verdict = F.when(F.col("_v").isNull(), "unchecked").when(~F.col("_fp").eqNullSafe(F.col("fingerprint")), "stale").otherwise(F.col("_v"))
    return facts.join(newest, list(keys), "left").select(*facts.columns, verdict.alias("verdict"))


def resourced(facts: DataFrame, pages: DataFrame, key: str, states: Column, order: Sequence[str]) -> DataFrame:
    """For each fact the first page of its subject's own site that states it. facts: key, fact_id; pages: key, url and what `states` and the order read."""
    met = facts.join(pages, key).where(states)
    return met.groupBy(key, "fact_id").agg(F.min_by("url", F.struct(*order)).alias("url"))


def without_listed(df: DataFrame, listed: DataFrame, key: str, unchanged: Column) -> DataFrame:
    """Df without the rows of listed keys that still look as expected; a changed one stays, one that can't be told too."""
    marked = listed.select(key).distinct().withColumn("_listed", F.lit(True))
    goes = F.coalesce(F.col("_listed") & unchanged, F.lit(False))
    return df.join(marked, key, "left").where(~goes).drop("_listed")
