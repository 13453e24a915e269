"""Operator 10: benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with k edits or fewer shares at least m - q + 1 - q*k of its q-grams with
that place, all within k neighbouring diagonals. Shared q-grams are counted in overlapping bands of 2k diagonals; bands
whose count meets the bound hold the place whole, so each is verified by an alignment of the item within these diagonals
alone. The bands of many items and texts are aligned together, a row of all bands at a time. Items of fewer than q
characters are looked for as they are, as whole words. Texts are compared in lower case with each run of white space as
one space.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import code_points, filter_rows, map_rows, mix, powers, settle, text_groups

#: Characters of a q-gram, and the edits that an item allows as a share of its length.
Q, EDIT_SHARE = 8, 0.1
#: Characters of items that go to the tasks at once; a larger benchmark takes a pass over the texts for each such block.
ITEM_BLOCK = 2_000_000
#: Shared q-grams that are counted at once, and cells of bands that are aligned at once: what a worker holds.
HITS_AT_ONCE, CELLS_AT_ONCE = 1_000_000, 400_000
#: Characters of an item after which alignments that can't end within the budget are given up.
STRETCH = 16

_SPACE = np.uint32(32)

@cache
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, if that is one code point, with white space as a space; and what is white space."""
    space, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            space[c], lower[c] = True, _SPACE
        elif (low := x.lower()) != x and len(low) == 1:
            lower[c] = ord(low)
    return lower, space


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compared form of the texts, where each begins (with the end), and each character's place in its own text."""
    lower, space = _folded()
    points, starts = code_points(texts)
    blank = space[points]
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[starts[:-1][np.diff(starts) > 0]] = True
    total = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    place = np.arange(len(points)) - np.repeat(starts[:-1], np.diff(starts))
    return lower[points[keep]], total[starts], place[keep]


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q consecutive characters."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(points) - q + 1, np.uint64)
    wide = points.astype(np.uint64)
    for j, p in enumerate(powers(q)):
        h += wide[j : j + len(h)] * p
    return mix(h)


def edit_budget(length: np.ndarray, q: int = Q, share: float = EDIT_SHARE) -> np.ndarray:
    """Edits allowed: the share, or as many as leave at least one q-gram that must be shared."""
    return np.minimum((length * share + 1e-9).astype(np.int64), np.maximum(0, (length - q) // q))


@cache
def _word_points() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


class Grams:
    """The q-grams of some items: sorted hashes, the postings of each, and a bitmap that most other q-grams miss."""

    def __init__(self, items: list[np.ndarray], q: int):
        self.q = q
        grams = [qgrams(f, q) for f in items]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])[order]
        self.bitmap = np.zeros(1 << 24, bool)
        self.bitmap[(self.keys >> np.uint64(40)).astype(np.int64)] = True

    def hits(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the points, the text of each and its key, where an item's q-gram stands within a text."""
        grams = qgrams(points, self.q)
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(40)).astype(np.int64)])
        key = np.searchsorted(self.keys, grams[at])
        good = self.keys[np.minimum(key, len(self.keys) - 1)] == grams[at] if len(self.keys) else np.zeros(len(at), bool)
        at, key = at[good], key[good]
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + self.q <= starts[text + 1]
        return at[inside], text[inside], key[inside]

    def postings(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the postings of these keys, one after another: the index of the key, and the posting."""
        n = self.first[key + 1] - self.first[key]
        return np.repeat(np.arange(len(key)), n), _ranges(self.first[key], n)


class Cells:
    """How a cell of an alignment is written: edits in the upper bits and, falling, the start in the lower ones.

    So the least of two has the fewer edits or, of equals, the shorter part of the text. The start is a diagonal of the
    band, counted from its first; `none` stands for more edits than any budget.
    """

    def __init__(self, width: int):
        self.kind, self.bits = (np.int32, 16) if width < 1 << 13 else (np.int64, 32)
        self.edit, self.low = self.kind(1 << self.bits), (1 << self.bits) - 1
        self.none = self.kind(1 << (29 if self.bits == 16 else 60))

    def first(self, there: np.ndarray) -> np.ndarray:
        """The row before an item's first character: a part may begin at every place of the text."""
        return np.where(there, self.kind(self.low) - np.arange(there.shape[1], dtype=self.kind), self.none)

    def rows(self, row: np.ndarray, pattern: np.ndarray, char: np.ndarray, there: np.ndarray) -> Iterator[np.ndarray]:
        """The rows after each further character of the patterns; char and there are the text's from the first cell's place on."""
        width = row.shape[1]
        step = np.arange(width, dtype=self.kind) * self.edit
        least = np.where(there, self.kind(0), self.none)
        row = np.minimum(row, self.none)
        for i in range(pattern.shape[1]):
            new = row + (char[:, i : i + width] != pattern[:, i, None]) * self.edit
            np.minimum(new[:, :-1], row[:, 1:] + self.edit, out=new[:, :-1])
            np.maximum(new, least[:, i + 1 : i + 1 + width], out=new)
            new -= step
            row = np.minimum.accumulate(new, axis=1)
            row += step
            np.maximum(row, least[:, i + 1 : i + 1 + width], out=row)
            yield row


def apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places (edits, start, end) those with the fewest edits, of equals the first, that don't overlap; by start."""
    taken: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(places):
        k = bisect.bisect(taken, (start,))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
            taken.insert(k, (start, end, edits))
    return [(edits, start, end) for start, end, edits in taken]


class Index:
    """A block of items, ready to be looked for in texts."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, share: float = EDIT_SHARE):
        """Items without any character but white space aren't looked for."""
        forms = [(i, folded([" ".join(t.split())])[0]) for i, t in zip(ids, texts, strict=True)]
        short = sorted(((i, f) for i, f in forms if 0 < len(f) < q), key=lambda x: len(x[1]))
        forms = [(i, f) for i, f in forms if len(f) >= q]
        self.ids = [i for i, _ in forms] + [i for i, _ in short]
        self.items = [f for _, f in forms] + [f for _, f in short]
        self.long = len(forms)
        length = np.array([len(f) for _, f in forms], dtype=np.int64)
        self.budget = edit_budget(length, q, share)
        self.width = np.maximum(1, self.budget)
        self.least = length - q + 1 - q * self.budget
        self.longest = int(length.max()) if len(length) else 0
        self.grams = Grams(self.items[: self.long], q)
        # The items in stretches of STRETCH characters; alignments go on together while their items' stretches are the same.
        known: dict[bytes, int] = {}
        self.stretches = [np.array([known.setdefault(f[k : k + STRETCH].tobytes(), len(known)) for k in range(0, len(f), STRETCH)]) for f in self.items[: self.long]]
        self.words = []
        for n in sorted({len(f) for _, f in short}):
            mine = [k for k in range(self.long, len(self.items)) if len(self.items[k]) == n]
            self.words.append((np.array(mine), Grams([self.items[k] for k in mine], n)))

    def __len__(self) -> int:
        return len(self.items)

    def bands(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and first diagonal of each band with enough shared q-grams."""
        at, text, key = self.grams.hits(points, starts)
        ends = np.cumsum(self.grams.first[key + 1] - self.grams.first[key])
        cells, counts, i = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS_AT_ONCE, side="right")))
            which, posting = self.grams.postings(key[i:j])
            item = self.grams.item[posting]
            diagonal = (at - starts[text])[i:j][which] - self.grams.place[posting]
            cell = (text[i:j][which] * self.long + item) << 34 | (diagonal + self.longest) // self.width[item] + 1
            more, n = np.unique(cell, return_counts=True)
            cells, back = np.unique(np.concatenate([cells, more]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
            i = j
        # A band is a cell and the next one: it begins with any cell that has shared q-grams, or the one before it.
        begins = np.unique(np.concatenate([cells, cells - 1]))
        at_cell = lambda c: np.where((k := np.minimum(np.searchsorted(cells, c), len(cells) - 1)) >= 0, np.where(cells[k] == c, counts[k], 0), 0)
        if not len(cells):
            return begins, begins, begins
        total = at_cell(begins) + at_cell(begins + 1)
        text, item = np.divmod(begins >> 34, self.long)
        met = total >= self.least[item]
        text, item, band = text[met], item[met], begins[met] & ((1 << 34) - 1)
        return text, item, (band - 1) * self.width[item] - self.longest

    def ends(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, item: np.ndarray, low: np.ndarray, budget: int) -> Iterator[tuple[int, int, int, int]]:
        """Band, cell, edits and start of the ends within the budget; bands are given by text (size points from begin), item and first diagonal.

        A diagonal is a place in the text less one in the item. Bands of one text and diagonal are aligned as one while
        their items are the same, and given up when no end within the budget is left.
        """
        length = np.array([len(f) for f in self.items])
        width = 2 * max(1, budget)
        cells = Cells(width)
        most = (budget + 1) * int(cells.edit)
        bands, mine = np.arange(len(item)), np.arange(len(item))  # the bands that go on, and the row of each
        row = cells.first((low[:, None] + np.arange(width) >= 0) & (low[:, None] + np.arange(width) <= size[:, None]))
        alike = np.unique((begin << 32) + low, return_inverse=True)[1] if len(item) else begin
        for first in range(0, int(length[item].max()) if len(item) else 0, STRETCH):
            stretch = np.array([self.stretches[x][first // STRETCH] for x in item[bands]])
            same = np.lexsort((stretch, mine, alike[bands])) if first == 0 else np.lexsort((stretch, mine))
            key = np.stack([stretch, alike[bands] if first == 0 else mine])[:, same]
            new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
            number = np.empty(len(bands), np.int64)
            number[same] = np.cumsum(new) - 1
            one = same[new]
            row, mine, shown = row[mine[one]], number, bands[one]  # shown: a band for each row
            left = length[item[shown]] - first
            pattern = np.zeros((len(one), min(STRETCH, int(left.max()))), np.uint32)
            for k, x in enumerate(item[shown]):
                part = self.items[x][first : first + STRETCH]
                pattern[k, : len(part)] = part
            place = (low[shown] + first)[:, None] + np.arange(width + pattern.shape[1] + 1)
            n = size[shown][:, None]
            char = np.where((place >= 0) & (place < n), points[np.minimum(begin[shown][:, None] + np.clip(place, 0, n), len(points) - 1)], np.uint32(0xFFFFFFFF))
            for i, row in enumerate(cells.rows(row, pattern, char, (place >= 0) & (place <= n))):  # noqa: B020
                if (done := left == i + 1).any():
                    at, cell = np.nonzero((row < most) & done[:, None])
                    values = row[at, cell].astype(np.int64)
                    for k in range(len(at)):
                        for band in bands[mine == at[k]].tolist():
                            yield band, int(cell[k]), int(values[k]) >> cells.bits, int(low[band]) + cells.low - (int(values[k]) & cells.low)
            on = ((row.min(axis=1) < most) & (left > STRETCH))[mine]
            bands, mine = bands[on], mine[on]
            if not len(bands):
                return

    def found(self, points: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """For each text and item the places (edits, start, end) within the budget, the best for each end."""
        best: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        text, item, low = self.bands(points, starts)
        for budget in np.unique(self.budget[item]).tolist():
            mine = np.flatnonzero(self.budget[item] == budget)
            at_once = max(1, CELLS_AT_ONCE // (2 * max(1, budget)))
            for k in range(0, len(mine), at_once):
                now = mine[k : k + at_once]
                t = text[now]
                for band, c, edits, start in self.ends(points, starts[t], starts[t + 1] - starts[t], item[now], low[now], budget):
                    x = int(item[now[band]])
                    end = len(self.items[x]) + int(low[now[band]]) + c
                    ends = best.setdefault((int(t[band]), x), {})
                    ends[end] = min((edits, -start), ends.get(end, (edits, -start)))
        out = {key: [(edits, -start, end) for end, (edits, start) in ends.items() if -start < end] for key, ends in best.items()}
        isalnum = _word_points() if self.words else None
        for mine, grams in self.words:
            at, text, key = grams.hits(points, starts)
            begin, end = starts[text], starts[text + 1]
            free = ((at == begin) | ~isalnum[points[np.maximum(at - 1, 0)]]) & ((at + grams.q == end) | ~isalnum[points[np.minimum(at + grams.q, len(points) - 1)]])
            which, posting = grams.postings(key[free])
            for a, t, x in zip((at - begin)[free][which].tolist(), text[free][which].tolist(), mine[grams.item[posting]].tolist(), strict=True):
                out.setdefault((t, x), []).append((0, a, a + grams.q))
        return out

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item (its place in ids), first and end character in the text as it is, and edits of each match."""
        for i, j in text_groups(texts):
            points, starts, place = folded(texts[i:j])
            for (t, item), places in self.found(points, starts).items():
                s = starts[t]
                for edits, a, b in apart(places):
                    yield i + t, item, int(place[s + a]), int(place[s + b - 1]) + 1, edits


def item_blocks(benchmark: DataFrame, most: int = ITEM_BLOCK) -> Iterator[Index]:
    """The benchmark's items in blocks of at most `most` characters (one longer item makes its own); null items aren't searched."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator()
    ids, texts, size = [], [], 0
    for r in rows:
        if texts and size + len(r["text"]) > most:
            if len(index := Index(ids, texts)):
                yield index
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if texts and len(index := Index(ids, texts)):
        yield index


MATCHES = "doc_id long, item_id long, start long, end long, edits int, similarity double"


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each place of a document that holds an item within its edit budget; no shuffle.

    start and end are characters of the whole text; similarity is 1 - edits / the item's length. Of places of one item
    that overlap the one with the fewest edits counts, of equals the first. Items of fewer than Q characters must stand
    as they are and as whole words; those without any aren't looked for. A null text has no match; rows that repeat give
    their matches again; without documents or items there are no rows.

    The benchmark goes to the tasks in blocks of items, a pass over the texts each. If there are several, the matches of
    a block are written before the next is sent, so that one block at a time is held.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out: DataFrame | None = None
    for index, last in _with_last(item_blocks(benchmark)):
        found, shared = _search(spark, rows, index)
        if not (last and out is None):
            found = settle(found)
            shared.destroy()
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], MATCHES) if out is None else out


def _with_last(blocks: Iterator[Index]) -> Iterator[tuple[Index, bool]]:
    """Each block and whether it is the last."""
    before = next(blocks, None)
    for block in blocks:
        yield before, False
        before = block
    if before is not None:
        yield before, True


def _search(spark: SparkSession, rows: DataFrame, index: Index) -> tuple[DataFrame, Broadcast]:
    shared = spark.sparkContext.broadcast(index)  # of ITEM_BLOCK characters

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        ids = batch.column(0).to_pylist()
        found = [(ids[t], index.ids[k], a, b, e, 1 - e / len(index.items[k])) for t, k, a, b, e in index.matches([t or "" for t in batch.column(1).to_pylist()])]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in enumerate(kinds)], [f.split()[0] for f in MATCHES.split(", ")])

    return map_rows(rows, work, MATCHES), shared


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; repeated rows and rows without an id are judged by their text.

    A null or empty text holds none and stays. An empty benchmark leaves all documents, an empty table gives no rows.
    """
    out = docs
    for index, last in _with_last(item_blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(column: pa.Array, shared=shared) -> np.ndarray:
            texts = [t or "" for t in column.cast(pa.string()).to_pylist()]
            clean = np.ones(len(texts), bool)
            clean[[t for t, *_ in shared.value.matches(texts)]] = False
            return clean

        out = filter_rows(out, "text", keep)
        if not last:
            out = settle(out)
            shared.destroy()
    return out
