"""Operator 6: quality rules as a short-circuit cascade.

Text statistics are computed on the UTF-8 bytes of whole Arrow batches, texts of any length whole. Each rule looks at the
documents that the rules before it left, with the statistics that these have made; the order is by rejections per second,
both estimated on a random sample that is measured where it is read. A document is kept if no rule rejects it, so the
order decides the time and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Block, blocks, filter_rows, gram_hashes, map_rows, mix, run_hashes

#: White space that parts words, and the characters counted as symbols.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True

#: Words in a window of repeats.
WINDOW = 5
#: Documents, about, on which a rule's cost and selectivity are estimated.
SAMPLE_ROWS = 2000


class TextStats:
    """Statistics of the texts of a block; each is computed when a rule first asks for it."""

    def __init__(self, block: Block):
        self.block, self._kept = block, {}

    def __len__(self) -> int:
        return len(self.block)

    def only(self, which: np.ndarray) -> TextStats:
        """The statistics of the texts that are flagged; what has been computed stays, less the others' part."""
        if which.all():
            return self
        out = TextStats(self.block.take(np.flatnonzero(which)))
        of_words = which[self._kept["word_text"]] if "word_text" in self._kept else None
        number = np.cumsum(which) - 1
        for name, value in self._kept.items():
            if name == "lines":
                out._kept[name] = (value[0][which], value[1][which])
            elif name == "words" and of_words is not None:
                text = self._kept["word_text"][of_words]
                moved = out.block.offsets[number[text]] - self.block.offsets[text]
                out._kept[name] = (value[0][of_words] + moved, value[1][of_words] + moved)
            elif name == "word_text":
                out._kept[name] = number[value[of_words]]
            elif name == "word_hashes" and of_words is not None:
                out._kept[name] = value[of_words]
            elif name not in ("words", "word_hashes"):
                out._kept[name] = value[which]
        return out

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word."""
        return self._once("words", lambda: self.block.runs(~_SPACE[self.block.data]))

    @property
    def word_text(self) -> np.ndarray:
        """The text of each word."""
        return self._once("word_text", lambda: np.searchsorted(self.block.offsets, self.words[0], side="right") - 1)

    @property
    def word_hashes(self) -> np.ndarray:
        return self._once("word_hashes", lambda: run_hashes(self.block.data, *self.words))

    @property
    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: np.bincount(self.word_text, minlength=len(self)))

    @property
    def word_chars(self) -> np.ndarray:
        """Code points outside white space: bytes that don't continue one."""
        return self._once("word_chars", lambda: self.block.per_text(~_SPACE[self.block.data] & ((self.block.data & 0xC0) != 0x80)))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: self.block.per_text(_SYMBOL[self.block.data]))

    @property
    def n_upper(self) -> np.ndarray:
        return self._once("n_upper", lambda: self.block.per_text(_UPPER[self.block.data]))

    @property
    def n_letters(self) -> np.ndarray:
        return self._once("n_letters", lambda: self.block.per_text(_LETTER[self.block.data] & ((self.block.data & 0xC0) != 0x80)))

    @property
    def n_shouts(self) -> np.ndarray:
        return self._once("n_shouts", lambda: self.block.per_text(self.block.data == ord("!")))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that hold a word: how many, and how many equal an earlier one of the same text."""
        return self._once("lines", self._lines)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        begins, ends = self.block.runs(self.block.data != 0x0A)
        if not len(begins):
            return np.zeros(len(self), np.int64), np.zeros(len(self), np.int64)
        total = np.concatenate(([0], np.cumsum(~_SPACE[self.block.data], dtype=np.int64)))
        full = total[ends] > total[begins]
        begins, ends = begins[full], ends[full]
        text = np.searchsorted(self.block.offsets, begins, side="right") - 1
        return np.bincount(text, minlength=len(self)), np.bincount(text[repeats(run_hashes(self.block.data, begins, ends), text, later=True)], minlength=len(self))

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words within a window of WINDOW words that the text has twice or more."""
        return self._once("n_repeat_words", self._repeat_words)

    def _repeat_words(self) -> np.ndarray:
        text, n = self.word_text, len(self.word_text)
        if n < WINDOW:
            return np.zeros(len(self), np.int64)
        whole = text[WINDOW - 1 :] == text[: n - WINDOW + 1]
        at = np.flatnonzero(whole)
        again = at[repeats(gram_hashes(self.word_hashes, WINDOW)[at], text[at], later=False)]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        return np.bincount(text[np.cumsum(edge)[:n] > 0], minlength=len(self))

    @property
    def n_doubled_words(self) -> np.ndarray:
        """Words equal to the word before."""
        same = (self.word_hashes[1:] == self.word_hashes[:-1]) & (self.word_text[1:] == self.word_text[:-1])
        return np.bincount(self.word_text[1:][same], minlength=len(self))


def repeats(hashes: np.ndarray, text: np.ndarray, later: bool) -> np.ndarray:
    """Indices of the hashes that their text has more than once, or (later) has had before."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    key = mix(hashes + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    if not later:
        same[:-1] |= same[1:]
    return order[same]


@dataclass(frozen=True)
class Rule:
    """A named test of texts; rejects gives a flag for each."""

    name: str
    rejects: Callable[[TextStats], np.ndarray]


#: Too short, or over a fifth of the words in windows that come again. These two are the base rules.
BASE_RULES = (
    Rule("few_words", lambda s: s.n_words < 10),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 20 * s.n_words),
)
#: Whole numbers on both sides, so that SQL gives the same verdict.
TEXT_RULES = (
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("shouts", lambda s: 5 * s.n_shouts > s.n_words),
    Rule("capitals", lambda s: 10 * s.n_upper > 3 * s.n_letters),
    Rule("few_letters", lambda s: 10 * s.n_letters < 6 * s.word_chars),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 20 * s.n_words)),
    Rule("repeated_lines", lambda s: 10 * s.n_dup_lines > 3 * s.lines[0]),
    Rule("doubled_words", lambda s: 10 * s.n_doubled_words > s.n_words),
)


def verdicts(stats: TextStats, rules: Sequence[Rule]) -> np.ndarray:
    """Which texts no rule rejects. A rule sees only what the rules before it left."""
    left = np.arange(len(stats))
    kept = np.zeros(len(stats), bool)
    for rule in rules:
        if not len(left):
            break
        good = ~rule.rejects(stats)
        left, stats = left[good], stats.only(good)
    kept[left] = True
    return kept


def measured_order(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + TEXT_RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, most first, as measured on about `rows` random documents.

    The sampled texts are measured by the tasks that read them; of these only a sum for each rule goes on. The sample
    decides the order of the rules alone, on which the verdict doesn't depend.
    """

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, _, block in blocks(batch.column(0)):
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = int(rule.rejects(TextStats(block)).sum())
                found.append((k, len(block), rejected, time.perf_counter() - began))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["rule", "seen", "rejected", "seconds"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    share = rows / max(1, texts.count())
    sample = texts if share >= 1 else texts.sample(share, 11)
    sums = map_rows(sample, measure, "rule long, seen long, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in sums}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), k))]


def keep_documents(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns; a null text counts as empty, so it is rejected. No shuffle.

    Rows that repeat and rows without an id are judged each by its text; an empty table gives no rows.
    """
    ordered = list(rules) if rules is not None else measured_order(docs)
    return filter_rows(docs, "text", lambda column: np.concatenate([verdicts(TextStats(b), ordered) for _, _, b in blocks(column.cast(pa.string()))]))


REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def rule_report(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The base statistics of every document, whether a base rule rejects it, and whether all rules keep it.

    A row for each row of docs: repeated rows and null ids stay, a null text counts as empty, an empty table gives none.
    """
    ordered = list(rules) if rules is not None else measured_order(docs, TEXT_RULES)

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for _, _, block in blocks(batch.column(1)):
            s = TextStats(block)
            failed = np.logical_or.reduce([rule.rejects(s) for rule in BASE_RULES])
            kept = ~failed
            kept[kept] = verdicts(s.only(kept), ordered)
            parts.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept))
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in REPORT.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), report, REPORT)
