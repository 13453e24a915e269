"""Operator 1: token counts by section, from one encoding of each whole document.

The tokenizer gives each token's character span in the document. Sections are the document's lines, or any spans that
the caller names; tokens are joined to the sections that their spans meet. A token that crosses a boundary belongs to
the section that holds most of its characters, the earlier one of equals: that rule gives every token to one section,
so the counts of a document's sections add up to its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.bpe import ByteLengths, encode
from waymark.llm.common import map_rows


def token_spans(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text the first and end character of each token of a byte-level BPE.

    A token that begins or ends within a character's bytes counts as holding that character.
    """
    out = []
    for text, raw in zip(texts, encode(ByteLengths, path, texts), strict=True):
        ends = np.cumsum(np.frombuffer(raw, dtype="<u2"), dtype=np.int64)
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        if not text.isascii():
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            begins, ends = character[begins], character[ends - 1] + 1
        out.append(np.stack([begins, ends], axis=1))
    return out


def line_starts(text: str) -> list[int]:
    """Where the lines of a text begin; a line's newline is its last character."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def attribute(spans: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sections [starts[i], starts[i+1]) of a text of `end` characters: tokens, and those of them that cross a boundary.

    A token meets the sections from that of its first character to that of its last. Of these it is given to the one
    that holds most of it, the earlier of equals.
    """
    edges = np.append(starts, max(end, starts[-1] + 1))
    begin, last = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    low = np.searchsorted(starts, begin, side="right") - 1
    high = np.searchsorted(starts, last - 1, side="right") - 1
    crosses = high > low
    owner = low.copy()
    for k in np.flatnonzero(crosses):
        held = np.minimum(edges[low[k] + 1 : high[k] + 2], last[k]) - np.maximum(edges[low[k] : high[k] + 1], begin[k])
        owner[k] = low[k] + int(held.argmax())
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crosses], minlength=len(starts))


COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def section_counts(docs: DataFrame, tokenizer: str, starts: Callable[[str], list[int]] = line_starts) -> DataFrame:
    """A row for each section of each document: its characters and the tokens that are its own.

    docs has doc_id and text. A null or empty text is one empty section without tokens; rows that repeat stay apart only
    by being repeated; an empty table gives no rows. No shuffle: a document's tokens and sections meet where it is read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for k, (text, spans) in enumerate(zip(texts, token_spans(texts, tokenizer), strict=True)):
            begin = np.array(starts(text), dtype=np.int64)
            n, crossing = attribute(spans, begin, len(text))
            for column, values in zip(parts, (np.full(len(begin), k), np.arange(len(begin)), begin, np.append(begin[1:], len(text)), n, crossing), strict=True):
                column.append(values)
        which, section, *rest = (np.concatenate(p) for p in parts)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(section.astype(np.int32)), *map(pa.array, rest)], [f.split()[0] for f in COUNTS.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, COUNTS)


def document_counts(sections: DataFrame) -> DataFrame:
    """doc_id, sections, n_tokens and n_crossing of each document; pre-aggregated before the shuffle."""
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_crossing").alias("n_crossing"))
