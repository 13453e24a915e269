"""Streams: batches of any size give the same, late rows and times that are up, and what a batch writes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import spark_rows
from waymark.streaming import packages, state

START = dt.datetime(2026, 1, 1)


def write(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def events(seed: int):
    r = random.Random(seed)
    out = []
    for k in range(400):
        kind = r.choice(["queued", "started", "file", "file", "file", "listed", "listed", "built"])
        name = r.choice(["results", "candidates", "run_log"])
        sha = f"list{r.randrange(6)}" if kind == "listed" else f"s{r.randrange(2)}"
        listed = r.choice(['{"results": "s0"}', '{"results": "s1", "run_log": "s0"}', '{"run_log": "s1"}', "{}", None])
        out.append((f"WP{r.randrange(7)}", START + dt.timedelta(minutes=k), k, kind, name, sha, r.choice([None, 0, 0, 1]), r.choice([None, 0, 3]), listed, r.choice([None, True, False])))
    return out


def by_loop(rows):
    held: dict = {}
    names = [f.split()[0] for f in packages.EVENTS.split(", ")]
    for row in rows:
        e = dict(zip(names, row, strict=True))
        held[e["package"]] = packages.step(held.get(e["package"], {"state": None, "started_at": None, "delivered_at": None, "handled": None, "note": None, "files": {}, "list": None, "events": 0}), e)
    return sorted((p, h["state"], h["handled"], h["note"], h["events"]) for p, h in held.items())


@pytest.mark.parametrize("parts", [1, 9])
def test_packages_whatever_the_batches(spark, tmp_path, parts):
    rows = events(3)
    size = -(-len(rows) // parts)
    folder = write(spark, str(tmp_path / "events"), [rows[k : k + size] for k in range(0, len(rows), size)], packages.EVENTS)
    log = state.Changes(spark, str(tmp_path / "log"))
    out = packages.package_states(state.parquet_stream(spark, folder, 1))
    assert log.take(out, "update")
    found = log.latest(out.schema, ["package"]).collect()
    assert sorted((r["package"], r["state"], r["handled"], r["note"], r["events"]) for r in found) == by_loop(rows)


def test_a_package_step_by_step():
    """The course of one package: a list waits for its files, a bad one comes back, a new list is handled anew."""
    base = {"at": START, "problems": 0, "late": 0, "listed": None, "partial": False, "name": None, "sha": None}
    held = {"state": None, "started_at": None, "delivered_at": None, "handled": None, "note": None, "files": {}, "list": None, "events": 0}
    course = [
        ({"kind": "started"}, None), ({"kind": "queued"}, "queued"), ({"kind": "started"}, "started"), ({"kind": "listed", "sha": "a", "listed": '{"results": "x"}'}, "started"), ({"kind": "file", "name": "results", "sha": "y"}, "started"),
        ({"kind": "file", "name": "results", "sha": "x", "problems": 2}, "needs_fix"), ({"kind": "file", "name": "results", "sha": "z", "late": 4}, "needs_fix"), ({"kind": "built"}, "needs_fix"), ({"kind": "listed", "sha": "b", "listed": '{"results": "z"}', "partial": True}, "pending_build"), ({"kind": "built"}, "ingested"),
        ({"kind": "listed", "sha": "b", "listed": '{"results": "z"}'}, "ingested"), ({"kind": "listed", "sha": "c", "listed": '{"run_log": "z"}'}, "needs_fix"),
    ]
    for event, want in course:
        held = packages.step(held, {**base, **event})
        assert held["state"] == want
    assert held["note"] == "no output listed" and held["events"] == len(course)


SEEN = "ts timestamp, k string, id long"


def test_a_batch_writes_its_own_keys_alone(spark, tmp_path):
    many = [(START + dt.timedelta(seconds=k), f"k{k % 500}", k) for k in range(2000)]
    few = [(START + dt.timedelta(hours=1, seconds=k), f"k{k % 3}", 5000 + k) for k in range(50)] + [(START - dt.timedelta(hours=1), "k1", 9000)]
    folder = write(spark, str(tmp_path / "rows"), [many, few], SEEN)
    log, made = state.Changes(spark, str(tmp_path / "log")), lambda b: state.sightings(b, ["k"], "ts", "id")
    log.take(state.parquet_stream(spark, folder, 1), made=made)
    rows = log.rows(made(spark.read.parquet(folder)).schema)
    assert sorted(r["count"] for r in rows.groupBy("_batch").count().collect()) == [3, 500]
    whole = state.seen(made(spark.read.parquet(folder)), ["k"])
    assert spark_rows(state.seen(rows, ["k"])) == spark_rows(whole)
    assert state.seen(rows, ["k"]).where("k = 'k1'").first()["first_id"] == 9000


def test_windows_end_and_late_rows_do_not_count(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    parts = [[(at(0, 5), "a", 1), (at(0, 50), "a", 2)], [(at(5), "a", 3)], [(at(5, 30), "b", 5)], [(at(0, 10), "a", 4), (at(9), "a", 6)]]
    folder = write(spark, str(tmp_path / "rows"), parts, SEEN)
    windows = state.windowed_counts(state.parquet_stream(spark, folder, 1), "ts", ["k"], {"ids": F.col("id")})
    log = state.Changes(spark, str(tmp_path / "log"))
    log.take(windows, "append")
    found = sorted((r["window_start"].hour, r["k"], r["n"], r["ids"]) for r in log.rows(windows.schema).collect())
    assert found == [(0, "a", 2, 3), (5, "a", 1, 3), (5, "b", 1, 5)]


def test_time_is_up_and_the_next_run_goes_on(spark, tmp_path):
    folder = write(spark, str(tmp_path / "rows"), [[(START, f"k{k}", k)] for k in range(6)], SEEN)
    log, stream = state.Changes(spark, str(tmp_path / "log")), state.parquet_stream(spark, folder, 1)
    assert not log.take(stream, seconds=0)
    assert log.rows(stream.schema).count() == 0
    assert not log.take(stream, seconds=0.3) or log.rows(stream.schema).count() == 6
    assert log.take(stream) and sorted(r["id"] for r in log.rows(stream.schema).collect()) == list(range(6))
    log.drop()
    assert log.rows(stream.schema).count() == 0
