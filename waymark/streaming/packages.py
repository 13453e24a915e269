"""Packages of work from the queue to the build, as a stream with state by package (Q17).

Events arrive in order for each package. Its state holds the files that are there by their hashes, the last list of what
was delivered, and how far the package is. A list is handled once, when every file on it has come with the hash it names:
problems in its files send it back, stamps later than the delivery are only noted, else it waits for the build. A changed list
is handled anew. What a batch writes are the packages that it has events of.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: package, at (event time), seq (order within a package), kind (queued, started, file, listed, built), and what the kind has: a
#: file's name, sha, problems and late stamps; a list's sha, its names with hashes as JSON, and whether it is partial.
EVENTS = "package string, at timestamp, seq long, kind string, name string, sha string, problems int, late int, listed string, partial boolean"
STATES = "package string, state string, started_at timestamp, delivered_at timestamp, handled string, note string, events long"
_HELD = "held string"

#: The file that tells of a run and is no output.
RUN_LOG = "run_log"


def step(held: dict, event: dict) -> dict:
    """The state of a package after one more event."""
    kind = event["kind"]
    held = {**held, "events": held["events"] + 1}
    if kind == "queued" and held["state"] is None:
        held["state"] = "queued"
    elif kind == "started" and held["state"] == "queued":
        held.update(state="started", started_at=str(event["at"]))
    elif kind == "file":
        held["files"] = {**held["files"], event["name"]: [event["sha"], int(event["problems"] or 0), int(event["late"] or 0)]}
    elif kind == "listed":
        held["list"] = [event["sha"], json.loads(event["listed"] or "{}"), bool(event["partial"]), str(event["at"])]
    elif kind == "built" and held["state"] == "pending_build":
        held["state"] = "ingested"
    return _handled(held)


def _handled(held: dict) -> dict:
    """Handles the last list if it is new, the package is known and all its files are there as listed."""
    if held["state"] is None or held["list"] is None or held["list"][0] == held["handled"]:
        return held
    sha, names, partial, at = held["list"]
    if not [n for n in names if n != RUN_LOG]:
        return {**held, "state": "needs_fix", "handled": sha, "note": "no output listed"}
    if any(held["files"].get(n, [None])[0] != want for n, want in names.items()):
        return held
    found = [held["files"][n] for n in names]
    held = {**held, "handled": sha, "delivered_at": at}
    if failed := sum(f[1] > 0 for f in found):
        return {**held, "state": "needs_fix", "note": f"{failed} files with problems"}
    notes = [f"{late} late stamps" for late in [sum(f[2] for f in found)] if late] + ["partial"] * partial
    return {**held, "state": "pending_build", "note": "; ".join(notes)}


def package_states(events: DataFrame) -> DataFrame:
    """The state of each package that a batch has events of, in update mode; events of a package that isn't queued yet wait in its state."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"state": None, "started_at": None, "delivered_at": None, "handled": None, "note": None, "files": {}, "list": None, "events": 0}
        rows = pd.concat(list(parts)).sort_values(["at", "seq"])
        for event in rows.to_dict("records"):
            held = step(held, {k: None if pd.isna(v) else v for k, v in event.items()})
        state.update((json.dumps(held),))
        yield pd.DataFrame([{"package": key[0], **{c: pd.to_datetime(held[c]) for c in ("started_at", "delivered_at")}, **{c: held[c] for c in ("state", "handled", "note", "events")}}])

    return events.groupBy("package").applyInPandasWithState(advance, STATES, _HELD, "update", GroupStateTimeout.NoTimeout)
