"""Carried verdicts against a plain loop: ties, nulls, extra columns."""

from __future__ import annotations

import datetime as dt
import random

from waymark.operators.merging import carried_over

DAY = dt.datetime(2024, 1, 1)


def test_carried_over(spark):
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.05 else DAY + dt.timedelta(days=rng.randint(0, 12))
    make = lambda n, x: [(k + x, rng.choice(["a", "b", None]), rng.choice(["verified", "gone", "timeout", None]), when()) for k in range(n)]
    checks, history = make(120, 0), make(60, 1000)
    schema = "row long, id string, verdict string, checked_at timestamp"
    found = carried_over(spark.createDataFrame(checks, schema), spark.createDataFrame(history, schema), ["id"], ["timeout"], 3).collect()

    def plain(row, key, verdict, at):
        past = [(h[3], h[2]) for h in history if key and h[1] == key and h[2] not in ("timeout", None) and at and h[3] and h[3] <= at]
        last = max(past, default=None)
        holds = verdict == "timeout" and last is not None and last[1] == "verified" and at <= last[0] + dt.timedelta(days=3)
        return (row, "verified" if holds else verdict, holds)

    assert sorted((r["row"], r["final"], r["carried_over"]) for r in found) == sorted((plain(*c) for c in checks), key=lambda x: x[0])
