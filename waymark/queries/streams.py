"""Streams of events merged into tables, held against the same in one batch (survey 2.11, Q17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.queries.registry import SQL_ONLY, Tables, query
from waymark.sources.store import checkpointed
from waymark.streaming import packages, state


def _settled(log: state.Changes, rows: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder; the stream's log goes."""
    out = checkpointed(rows)
    log.drop()
    return out


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS times, max(ts) AS last_seen FROM {events} GROUP BY user_id, event_type")
def stream_state_equals_batch(t: Tables) -> DataFrame:
    """First sight, number and last sight by key, merged from what each batch of a stream has."""
    log, keys = state.Changes(t.spark), ["user_id", "event_type"]
    stream = state.parquet_stream(t.spark, f"{t.sf_dir}/events.parquet")
    log.take(stream, made=lambda batch: state.sightings(batch, keys, "ts", "event_id"))
    return _settled(log, state.seen(log.rows(state.sightings(t.events, keys, "ts", "event_id").schema), keys))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS large FROM {events} GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    """Events by hour and kind from a stream in update mode, whose windows end by a watermark."""
    large = F.when(F.col("value") > 50, F.lit(1)).otherwise(0).cast("long")
    windows = state.windowed_counts(state.parquet_stream(t.spark, f"{t.sf_dir}/events.parquet"), "ts", ["event_type"], {"large": large})
    log = state.Changes(t.spark)
    log.take(windows, "update")
    return _settled(log, log.latest(windows.schema, ["window_start", "event_type"]))


#: Events of packages from the table of events: package, at, seq and what packages.EVENTS has.
_EVENTS = """
SELECT 'WP' || CAST(user_id % 211 AS STRING) AS package, ts AS at, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'started' WHEN 2 THEN 'file' WHEN 3 THEN 'file' WHEN 4 THEN 'listed' WHEN 5 THEN 'file' ELSE 'built' END AS kind,
  CASE event_id % 3 WHEN 0 THEN 'results' WHEN 1 THEN 'candidates' ELSE 'run_log' END AS name, CASE WHEN event_id % 7 = 4 THEN 'list' || CAST(event_id % 10 AS STRING) ELSE 's' || CAST(event_id % 2 AS STRING) END AS sha, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS problems, CASE WHEN event_id % 5 = 0 THEN 2 END AS late,
  CASE event_id % 5 WHEN 0 THEN '{"results": "s0"}' WHEN 1 THEN '{"results": "s1", "run_log": "s0"}' WHEN 2 THEN '{"candidates": "s1"}' WHEN 3 THEN '{"run_log": "s0"}' ELSE '{"results": "s0", "candidates": "s0"}' END AS listed, event_id % 9 = 0 AS partial
FROM """

_FILES = ("results", "candidates", "run_log")
SQL_ONLY["package_events"] = _EVENTS.replace("{", "{{").replace("}", "}}") + "{events}"
_MISSING = " OR ".join(f"(want_{n} IS NOT NULL AND {n}_sha IS DISTINCT FROM want_{n})" for n in _FILES)
_OUTPUTS = "want_results IS NOT NULL OR want_candidates IS NOT NULL"
_FAILED = " + ".join(f"CASE WHEN want_{n} IS NOT NULL AND {n}_problems > 0 THEN 1 ELSE 0 END" for n in _FILES)
_LATE = " + ".join(f"CASE WHEN want_{n} IS NOT NULL THEN {n}_late ELSE 0 END" for n in _FILES)
_TODO = "state IS NOT NULL AND list IS NOT NULL AND list IS DISTINCT FROM handled"
_READY = f"({_TODO}) AND ({_OUTPUTS}) AND NOT ({_MISSING})"


@query(f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY "at", seq) AS k, count(*) OVER (PARTITION BY package) AS n FROM {{package_events}}),
f AS (
  SELECT DISTINCT package, 0::BIGINT AS k, n, NULL::VARCHAR AS state, NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS delivered_at, NULL::VARCHAR AS handled, NULL::VARCHAR AS note, NULL::VARCHAR AS list, false AS partial, NULL::TIMESTAMP AS listed_at,
    {", ".join(f"NULL::VARCHAR AS {n}_sha, 0 AS {n}_problems, 0 AS {n}_late, NULL::VARCHAR AS want_{n}" for n in _FILES)} FROM e
  UNION ALL
  SELECT package, k, n, CASE WHEN ({_TODO}) AND NOT ({_OUTPUTS}) THEN 'needs_fix' WHEN {_READY} THEN CASE WHEN {_FAILED} > 0 THEN 'needs_fix' ELSE 'pending_build' END ELSE state END, started_at, CASE WHEN {_READY} THEN listed_at ELSE delivered_at END,
    CASE WHEN ({_TODO}) AND NOT ({_OUTPUTS}) OR {_READY} THEN list ELSE handled END,
    CASE WHEN ({_TODO}) AND NOT ({_OUTPUTS}) THEN 'no output listed' WHEN {_READY} THEN CASE WHEN {_FAILED} > 0 THEN ({_FAILED}) || ' files with problems' ELSE concat_ws('; ', CASE WHEN {_LATE} > 0 THEN ({_LATE}) || ' late stamps' END, CASE WHEN partial THEN 'partial' END) END ELSE note END,
    list, partial, listed_at, {", ".join(f"{n}_sha, {n}_problems, {n}_late, want_{n}" for n in _FILES)}
  FROM (SELECT f.package, e.k, f.n, CASE WHEN kind = 'queued' AND state IS NULL THEN 'queued' WHEN kind = 'started' AND state = 'queued' THEN 'started' WHEN kind = 'built' AND state = 'pending_build' THEN 'ingested' ELSE state END AS state,
      CASE WHEN kind = 'started' AND state = 'queued' THEN "at" ELSE started_at END AS started_at, delivered_at, handled, note, CASE WHEN kind = 'listed' THEN sha ELSE list END AS list, CASE WHEN kind = 'listed' THEN e.partial ELSE f.partial END AS partial, CASE WHEN kind = 'listed' THEN "at" ELSE listed_at END AS listed_at,
      {", ".join(f"CASE WHEN kind = 'file' AND name = '{n}' THEN sha ELSE {n}_sha END AS {n}_sha, CASE WHEN kind = 'file' AND name = '{n}' THEN problems ELSE {n}_problems END AS {n}_problems, CASE WHEN kind = 'file' AND name = '{n}' THEN coalesce(late, 0) ELSE {n}_late END AS {n}_late, CASE WHEN kind = 'listed' THEN json_extract_string(listed, '$.{n}') ELSE want_{n} END AS want_{n}" for n in _FILES)}
    FROM f JOIN e ON e.package = f.package AND e.k = f.k + 1))
SELECT package, state, started_at, delivered_at, handled, note, n AS events FROM f WHERE k = n""")
def package_states(t: Tables) -> DataFrame:
    """Where each package is after all its events, by a stream with state by package (Q17)."""
    stream = state.parquet_stream(t.spark, f"{t.sf_dir}/events.parquet")
    rows = packages.package_states(t.spark.sql(SQL_ONLY["package_events"], events=stream))
    log = state.Changes(t.spark)
    log.take(rows, "update")
    return _settled(log, log.latest(rows.schema, ["package"]))
