"""Operator 3: best-fit packing of tokenised documents into training sequences.

A configuration is a multiset of piece lengths that fits in one sequence. The covering linear program over the
length histogram (at most `capacity` rows, whatever the corpus) is solved by multiplicative weights; each round prices
a configuration with an unbounded-knapsack dynamic program. The solution is rounded down to whole sequences, and what
rounding leaves is placed best-fit, longest first, still on the histogram. Documents meet the plan through their rank
among pieces of one length, which Spark counts in buckets, so that a length that a third of all pieces share is no
single task's work.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.bpe import WordIds, encode
from waymark.llm.common import map_rows, settle

CAPACITY = 2048
#: Rounds of the multiplicative-weights solver and its step: fixed, so the driver's work doesn't grow with the corpus.
ROUNDS, STEP = 500, 0.35
#: Share of the fractional solution that is rounded down to whole sequences; the rest, with pieces of all lengths, is placed best-fit.
ROUNDED = 0.9
#: Pieces that one bucket of ranks holds, about.
BUCKET_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: its ids, then end_id, cut only if they exceed the capacity.

    docs has doc_id and text; a null text counts as empty, and an empty text is one piece that holds end_id alone.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode(WordIds, tokenizer, texts), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[at : at + 4 * capacity]
                for column, value in zip(out, (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


# The plan, from the histogram of lengths alone.

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def priced_configuration(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of highest total price: unbounded knapsack over lengths 1..capacity with price[length] > 0."""
    lengths = np.flatnonzero(price > 0)
    if not len(lengths):
        return {}
    worth = price[lengths]
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fits[room]
        total = best[room - lengths[:k]] + worth[:k]
        at = int(total.argmax())
        best[room], pick[room] = total[at], lengths[at]
    room, out = capacity, {}
    while room >= lengths[0]:
        out[int(pick[room])] = out.get(int(pick[room]), 0) + 1
        room -= int(pick[room])
    return out


def configuration_lp(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional numbers of configurations that cover counts[length] pieces of each length, by multiplicative weights.

    The price of a length falls as its pieces get covered. Each round takes as much of the best-priced configuration as
    covers the given share of its scarcest length; lengths that are covered in full have no price.
    """
    left, price = counts.astype(float), np.where(counts > 0, np.arange(capacity + 1) / capacity, 0.0)
    total: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        chosen = priced_configuration(np.where(left > 0.5, price, 0.0), capacity)
        if not chosen:
            break
        lengths, n = np.array(list(chosen)), np.array(list(chosen.values()))
        # A configuration can't hold more pieces of a length than there are.
        n = np.minimum(n, np.maximum(1, np.ceil(left[lengths]).astype(np.int64)))
        scarce = float((left[lengths] / n).min())
        take = scarce if scarce <= 4 else max(1.0, step * scarce)
        key = tuple(sorted(zip(lengths.tolist(), n.tolist(), strict=True), reverse=True))
        total[key] = total.get(key, 0.0) + take
        left[lengths] = np.maximum(0.0, left[lengths] - take * n)
        price[lengths] *= np.exp(-step * take * n / np.maximum(1.0, counts[lengths]))
    return total


def best_fit(counts: np.ndarray, capacity: int, open_bins: dict[tuple[tuple[int, int], ...], int]) -> Plan:
    """Places counts[length] pieces, longest first, each where the least room is left; bins that are alike count as one entry."""
    bins: dict[int, dict[tuple, int]] = {}

    def put(content: tuple, number: int) -> None:
        room = capacity - sum(a * b for a, b in content)
        bins.setdefault(room, {})
        bins[room][content] = bins[room].get(content, 0) + number

    for content, number in open_bins.items():
        put(content, number)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        if not left:
            continue
        for room in sorted(r for r in bins if r >= length):
            each = room // length
            for content in sorted(bins[room]):
                if not left:
                    break
                full = min(bins[room][content], left // each)
                parts = [(full, each)] if full else []
                if (some := left - full * each) and full < bins[room][content]:
                    parts.append((1, min(some, each)))
                for number, n in parts:
                    bins[room][content] -= number
                    left -= number * n
                    put((*content, (length, n)), number)
                if not bins[room][content]:
                    del bins[room][content]
            if not bins[room]:
                del bins[room]
            if not left:
                break
        if left:
            each = capacity // length
            if left // each:
                put(((length, each),), left // each)
            if left % each:
                put(((length, left % each),), 1)
    return sorted((c, n) for group in bins.values() for c, n in group.items() if n)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Configurations with their numbers of sequences; together they hold exactly the histogram's pieces."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole: Plan = [(((capacity, 1),), int(counts[capacity]))] if counts[capacity] else []
    left = counts.copy()
    left[capacity] = 0
    fractions = configuration_lp(left, capacity, rounds)
    closed: Plan = []
    open_bins: dict[tuple[tuple[int, int], ...], int] = {}
    for content, x in sorted(fractions.items(), key=lambda e: (-e[1], e[0])):
        number = min([math.floor(ROUNDED * x + 1e-9), *(int(left[a]) // b for a, b in content)])
        if number > 0:
            for a, b in content:
                left[a] -= number * b
            if sum(a * b for a, b in content) == capacity:
                closed.append((content, number))
            else:
                open_bins[content] = open_bins.get(content, 0) + number
    return whole + closed + best_fit(left, capacity, open_bins)


def slots(plan: Plan) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: from which rank on, in which sequences, how many to a sequence, from which offset."""
    rows, used, sequence = [], {}, 0
    for content, number in plan:
        offset = 0
        for length, n in content:
            first = used.get(length, 0)
            rows.append((length, first, sequence, n, offset))
            used[length] = first + n * number
            offset += n * length
        sequence += number
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Adds `rank`, from 0 without gaps among the rows of a length. Each length is dealt over buckets by a hash."""
    buckets = max(32, math.ceil(total / BUCKET_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Packs the documents into as few sequences as the plan finds; a row for each piece.

    Columns: those of `pieces`, sequence_id and offset. A sequence's pieces lie gapless from offset 0. Rows that repeat
    a doc_id, or have none, are packed like any others; an empty table gives no rows.
    """
    rows = settle(pieces(docs, tokenizer, capacity))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = packing_plan(histogram, capacity, rounds)
    length, first, sequence, each, offset = slots(plan)
    base = np.int64(1) << 44
    table = docs.sparkSession.sparkContext.broadcast((length * base + first, first, sequence, each, offset))
    schema = f"{PIECES}, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, each, offset = table.value
        for batch in batches:
            size, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, size * base + rank, side="right") - 1
            within = rank - first[at]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence[at] + within // each[at]), pa.array(offset[at] + within % each[at] * size)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return ranked(rows, sum(histogram.values())).mapInArrow(place, schema)


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: pieces of over half the capacity can't share, and tokens need room."""
    long = sum(n for a, n in histogram.items() if 2 * a > capacity)
    return max(long, math.ceil(sum(a * n for a, n in histogram.items()) / capacity))


def gaps(packed: DataFrame) -> DataFrame:
    """The sequences of a packing that have a gap, an overlap or no beginning; empty if it is sound."""
    order = Window.partitionBy("sequence_id").orderBy("offset")
    return packed.withColumn("due", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0))).where("due != offset").select("sequence_id", "offset", "due")


__all__ = ["best_fit", "configuration_lp", "gaps", "lower_bound", "pack", "packing_plan", "pieces", "priced_configuration", "slots"]
