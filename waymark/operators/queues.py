"""Work queues in columns: what is due, what to fetch, how runs went."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.stats import latest_by


def valid(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """cache entries that haven't expired."""
    return df.where(F.col(expires) > now)


def fetch_queue(subjects: DataFrame, attempts: DataFrame, now: Column, limit: int, fresh_days: int = 30, back_off_hours: int = 48) -> DataFrame:
    """Subjects without a good fetch in the last days and without an attempt in the last hours; never tried first, then longest ago.

    attempts: subject_id, seen_at, ok. Both maxima come from one pass over the attempts.
    """
    last = attempts.groupBy("subject_id").agg(F.max(F.when(F.col("ok"), F.col("seen_at"))).alias("last_ok"), F.max("seen_at").alias("last_try"))
    due = subjects.select("subject_id").join(last, "subject_id", "left")
    stale = F.col("last_ok").isNull() | (F.col("last_ok") < now - F.expr(f"INTERVAL {fresh_days} DAYS"))
    rested = F.col("last_try").isNull() | (F.col("last_try") < now - F.expr(f"INTERVAL {back_off_hours} HOURS"))
    return due.where(stale & rested).orderBy(F.asc_nulls_first("last_try"), "subject_id").limit(limit)


def pending_groups(artifacts: DataFrame, limit: int) -> DataFrame:
    """Subjects with pending artifacts, the longest waiting first, with how many."""
    return artifacts.where("status = 'pending'").groupBy("subject_id").agg(F.min("seen_at").alias("waiting_since"), F.count(F.lit(1)).alias("n")).orderBy("waiting_since", "subject_id").limit(limit)


def latest_versions(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each subject and kind, of equal times the one with the greatest id."""
    return latest_by(artifacts, ["subject_id", "kind"], ["seen_at", "artifact_id"])


def ordered_inputs(artifacts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """For each subject the ids and kinds of its newest artifacts, by the kinds' fixed order, then id; other kinds last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0)), F.lit(len(kinds) + 1))
    newest = latest_versions(artifacts).select("subject_id", F.struct(place.alias("place"), "artifact_id", "kind").alias("e"))
    return newest.groupBy("subject_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("subject_id", F.transform("e", lambda x: x["artifact_id"]).alias("artifact_ids"), F.transform("e", lambda x: x["kind"]).alias("kinds"))


def session_of(artifacts: DataFrame, anchor_kind: str, days: int = 1) -> DataFrame:
    """Artifacts within so many days of their subject's newest good one of a kind."""
    anchor = artifacts.where((F.col("kind") == anchor_kind) & F.col("ok")).groupBy("subject_id").agg(F.max("seen_at").alias("_anchor"))
    return artifacts.join(anchor, "subject_id").where((F.col("seen_at") >= F.col("_anchor") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("seen_at") <= F.col("_anchor") + F.expr(f"INTERVAL {days} DAYS"))).drop("_anchor")


def due_for_extraction(current: DataFrame, recorded: DataFrame, version: str) -> DataFrame:
    """Subjects whose inputs, in any order, or version aren't those of the recorded extraction. Both: subject_id, artifact_ids; recorded: version."""
    done = recorded.select("subject_id", F.array_sort("artifact_ids").alias("_ids"), F.col("version").alias("_v"))
    return current.join(done, "subject_id", "left").where(~F.array_sort("artifact_ids").eqNullSafe(F.col("_ids")) | ~F.col("_v").eqNullSafe(F.lit(version))).select("subject_id")


def requeue(artifacts: DataFrame, stale: DataFrame, limit: int) -> DataFrame:
    """The artifacts with those of the first `limit` stale subjects (by id) that have something usable and nothing pending set to pending."""
    usable = artifacts.groupBy("subject_id").agg(F.bool_or(F.col("status") == "ok").alias("_ok"), F.bool_or(F.col("status") == "pending").alias("_pending"))
    chosen = stale.select("subject_id").distinct().join(usable.where("_ok and not _pending"), "subject_id", "left_semi").orderBy("subject_id").limit(limit).withColumn("_again", F.lit(True))
    out = artifacts.join(chosen, "subject_id", "left")
    return out.withColumn("status", F.when(F.col("_again") & (F.col("status") == "ok"), F.lit("pending")).otherwise(F.col("status"))).select(*artifacts.columns)


def stale_counts(subjects: DataFrame, artifacts: DataFrame, version: str) -> DataFrame:
    """Subjects of another version, and those of them that could be queued again: something usable, nothing pending."""
    flags = artifacts.groupBy("subject_id").agg(F.bool_or(F.col("status") == "ok").alias("_ok"), F.bool_or(F.col("status") == "pending").alias("_pending"))
    old = subjects.where(~F.col("version").eqNullSafe(F.lit(version))).join(flags, "subject_id", "left")
    return old.agg(F.count(F.lit(1)).alias("stale"), F.count_if(F.coalesce("_ok", F.lit(False)) & ~F.coalesce("_pending", F.lit(False))).alias("queueable"))


def unprocessed(df: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows that no run has seen, whether it found something or not."""
    return df.join(processed.select(key), key, "left_anti")


def run_status(rows: DataFrame) -> DataFrame:
    """By run, processed, ok and error rows, and the run's status: ok, partial or error. rows: run_id, ok."""
    out = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows_processed"), F.count_if("ok").alias("rows_ok"), F.count_if(~F.col("ok")).alias("rows_error"))
    return out.withColumn("status", F.when(F.col("rows_error") == 0, "ok").when(F.col("rows_ok") == 0, "error").otherwise("partial"))


def enrichment_order(places: DataFrame, priority: Sequence[str], limit: int) -> DataFrame:
    """Most reviews first, then the cities of a list, then id."""
    return places.orderBy(F.desc("review_count"), F.when(F.lower("city").isin(*[c.lower() for c in priority]), 0).otherwise(1), "place_id").limit(limit)


def transition(state: Column, event: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Q17: the state after an event, by (state, event, new state); anything else leaves it."""
    out = state
    for old, what, new in reversed(rules):
        out = F.when((state == old) & (event == what), F.lit(new)).otherwise(out)
    return out
