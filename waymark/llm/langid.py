"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

Counts come from Spark tasks over a bounded sample of labelled documents; the matrix of log probabilities, a row for
each bucket and a column for each language, is broadcast, and batches of texts are scored as sums of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import code_points, filter_rows, held_out, map_rows, settle, text_groups, tuned

#: Buckets of n-grams (a power of two), and the orders of n-gram.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: Labelled documents that the counts are made from, about: of each language an equal part, by a hash of the ids.
TRAIN_ROWS = 20_000
#: Weight of each n-gram in the posterior: neighbouring n-grams overlap, so full weight would make all scores 0 or 1.
TEMPER = 0.1

_SPACE = np.uint32(32)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower case if that is one letter (else itself), and whether it is a letter."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            low = x.lower()
            if low != x and len(low) == 1:
                lower[c] = ord(low)
    return lower, letter


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters in lower case with one space for each run of other characters; where texts begin (with the end); letters of each."""
    lower, letter = _letters()
    points, starts = code_points([f" {t} " for t in texts])
    is_letter = letter[points]
    out = np.where(is_letter, lower[points], _SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[starts[:-1]] = True
    total = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    count = np.concatenate(([0], np.cumsum(is_letter, dtype=np.int64)))
    return out[keep], total[starts], np.diff(count[starts])


def gram_buckets(points: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that stay within a text, and where each text's begin, with the end."""
    size = np.maximum(0, np.diff(starts) - n + 1)
    if len(points) < n or not size.sum():
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    h = np.full(len(points) - n + 1, n, dtype=np.uint32)
    for j in range(n):
        h = h * np.uint32(0x01000193) ^ points[j : j + len(h)]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)
    inside = np.ones(len(h), bool)
    if n > 1:
        for j in range(1, n):
            at = starts[1:-1] - j
            inside[at[(at >= 0) & (at < len(h))]] = False
    return h[inside].astype(np.int64), np.concatenate(([0], np.cumsum(size)))


@dataclass(frozen=True)
class Model:
    """Log probabilities of buckets (rows) in languages (columns), and of the languages."""

    languages: tuple[str, ...]
    gram: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text, -1 if it has no letter, and the tempered posterior."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for i, j in text_groups(texts):
            points, starts, n_letters = letters_of(texts[i:j])
            sums = np.tile(self.prior, (j - i, 1))
            for n in ORDERS:
                buckets, at = gram_buckets(points, starts, n)
                if not len(buckets):
                    continue
                full = np.flatnonzero(np.diff(at))
                for k in range(len(self.languages)):
                    sums[full, k] += TEMPER * np.add.reduceat(self.gram[:, k][buckets], at[full], dtype=np.float64)
            top = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            best[i:j] = np.where(n_letters > 0, top, -1)
            score[i:j] = np.where(n_letters > 0, share, 0.0)
        return best, score


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from text and lang of the documents that aren't held out; None if no such document has a language and a letter.

    Each language has an equal part of `rows`: of one that has more, those documents are learned from whose hashed id falls
    within part / count, a sample of whole texts that depends on ids alone; of one that has fewer, all. How frequent
    languages are is counted on all documents. Rows that repeat count as often.
    """
    tuned(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    there = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not there:
        return None
    part = rows / len(there)
    shares = docs.sparkSession.createDataFrame([(lang, int((1 << 30) * min(1.0, part / n))) for lang, n in there.items()], "lang string, below int")
    labelled = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
        found: list[tuple] = []
        for lang in sorted(set(langs)):
            sums = np.zeros(BUCKETS, np.int64)
            mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for i, j in text_groups(mine):
                points, starts, _ = letters_of(mine[i:j])
                for n in ORDERS:
                    sums += np.bincount(gram_buckets(points, starts, n)[0], minlength=BUCKETS)
            found.append((lang, len(mine), sums.astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["lang", "n", "counts"])

    def add(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.setdefault(lang, [0, np.zeros(BUCKETS, np.int64)])
                have[0] += n
                have[1] += np.frombuffer(raw, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()]), pa.array([v[1].tobytes() for v in sums.values()])], ["lang", "n", "counts"])

    schema = "lang string, n long, counts binary"
    # Each task adds up its own batches; one row for each task and language is left, which a few tasks add up again. A task has
    # one Python worker for both steps: idle workers stay, and take turns in what comes later.
    partial = labelled.select("text", "lang").mapInArrow(lambda batches: add(count(b) for b in batches if b.num_rows), schema)
    sums = settle(partial.repartition(4, F.xxhash64("lang"))).mapInArrow(add, schema).collect()
    if not sums:
        return None
    total: dict[str, np.ndarray] = {}
    for r in sums:
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    languages = tuple(sorted(total))
    counts = np.stack([total[x] for x in languages], axis=1) + 0.5
    prior = np.log(np.array([there[x] for x in languages]) / sum(there[x] for x in languages))
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32).copy(order="F"), prior)


PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of every document: a learned one, or und (score 0) without text, letters or a model. No shuffle.

    A row for each row of docs; a null id counts as held out; of languages that are equally likely the first by name is
    predicted. Texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the corpus

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        best, score = shared.value.score(texts) if shared.value else (np.full(len(texts), -1), np.zeros(len(texts)))
        names = (*(shared.value.languages if shared.value else ()), "und")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([names[k] for k in best], pa.string()), pa.array(score)], [f.split()[0] for f in PREDICTION.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, predict, PREDICTION)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The documents whose language is a learned one with at least this score, with all their columns.

    Rows that repeat and rows without an id are judged each by its text; null texts and texts without a letter go. Without
    a model, where no row has a language to learn from, there is nothing to judge by and all documents stay.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(column: pa.Array) -> np.ndarray:
        best, score = shared.value.score([t or "" for t in column.cast(pa.string()).to_pylist()])
        return (best >= 0) & (score >= least)

    return filter_rows(docs, "text", keep)
