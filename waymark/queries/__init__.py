"""All registered queries; importing the modules registers them."""

from waymark.queries import directory, excerpts, merged, operations, ranges, relations, sanitized, schedules, streams, texts  # noqa: F401
from waymark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
