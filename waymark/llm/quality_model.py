"""Operator 4: a quality classifier, logistic regression over hashed word n-grams trained by FTRL-proximal.

A bounded sample of labelled documents is dealt over a few Spark tasks; each trains on its share, and the weights are
averaged. Whole texts are scored as sparse dot products of their n-gram shares with the weights, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Block, blocks, held_out, map_rows, mix, run_hashes, tuned

#: Buckets of n-grams, as a power of two.
BUCKET_BITS = 18
#: Labelled documents that are learned from at most, the tasks that share them, and passes over each share.
TRAIN_ROWS, SHARDS, PASSES = 12_000, 6, 3
#: FTRL-proximal: learning rate, its offset, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: What a text's n-gram shares are multiplied by.
SCALE = 20.0
#: Scores from which on the label is predicted to be 1.
THRESHOLD = 0.7

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: The values of a bigram of two equal tokens, and of a trigram whose first and last are equal, whichever they are.
_SAME, _AGAIN = (np.uint64(x) for x in (0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F))


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of tokens, and where each text's begin, with the end.

    Tokens are runs of letters and digits and runs of punctuation. Trigrams count if they end as they begin.
    """
    kind = _CLASS[block.data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[block.offsets[:-1][block.sizes > 0]] = True
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(kind))
    full = kind[begins] > 0
    begins, ends = begins[full], ends[full]
    text = np.searchsorted(block.offsets, begins, side="right") - 1
    one = run_hashes(block.data, begins, ends)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    two[one[:-1] == one[1:]] = _SAME
    again = np.flatnonzero((one[2:] == one[:-2]) & (text[2:] == text[:-2])) + 2
    owner = np.concatenate([text, text[1:], text[again]])
    inside = np.concatenate([np.ones(len(text), bool), text[1:] == text[:-1], np.ones(len(again), bool)])
    every, owner = np.concatenate([one, two, np.full(len(again), _AGAIN)])[inside], owner[inside]
    order = np.argsort(owner, kind="stable")
    buckets = (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[order]
    return buckets, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(block)))))


def shares(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their scaled shares."""
    which, n = np.unique(buckets, return_counts=True)
    return which, n * (SCALE / len(buckets)) if len(buckets) else n.astype(float)


class Ftrl:
    """FTRL-proximal for logistic loss, one example at a time; bias has no penalty."""

    def __init__(self) -> None:
        size = (1 << BUCKET_BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[which], self.n[which]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, which: np.ndarray, x: np.ndarray, label: int) -> None:
        which, x = np.append(which, 1 << BUCKET_BITS), np.append(x, 1.0)
        w = self.weights(which)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        step = (np.sqrt(self.n[which] + g * g) - np.sqrt(self.n[which])) / ALPHA
        self.z[which] += g - step * w
        self.n[which] += g * g


@dataclass(frozen=True)
class Model:
    """Weights of the buckets, the bias last."""

    weights: np.ndarray

    def score(self, block: Block) -> np.ndarray:
        buckets, at = features(block)
        sums = np.zeros(len(block))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            sums[full] = np.add.reduceat(self.weights[buckets], at[full], dtype=np.float64) * (SCALE / np.diff(at)[full])
        return 1 / (1 + np.exp(-np.clip(sums + float(self.weights[-1]), -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Learns labels.<label> from the texts of labelled documents that aren't held out, at most `rows` of them.

    Which, if there are more, a hash of the id decides. The chosen ids are few by that bound, so they are broadcast to
    the scan of the documents and no text but theirs moves. Of rows with one id the text that sorts first is learned from,
    once, with the larger label if labels repeat; null texts count as empty; the number of texts is bounded, not their
    length. Without labelled documents every score is one half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    tuned(docs.sparkSession)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, block in blocks(batch.column(1)):
                buckets, at = features(block)
                seen += [(ids[i + k], *shares(buckets[at[k] : at[k + 1]]), wanted[i + k]) for k in range(j - i)]
        if seen:
            seen.sort(key=lambda e: ((e[0] * 0x9E3779B97F4A7C15) % (1 << 64), len(e[1])))
            model = Ftrl()
            for _ in range(PASSES):
                for _, which, x, wanted in seen:
                    model.update(which, x, wanted)
            yield pa.RecordBatch.from_arrays([pa.array([len(seen)]), pa.array([model.weights().astype("<f4").tobytes()])], ["n", "weights"])

    found = texts.repartition(SHARDS, F.xxhash64("doc_id")).mapInArrow(learn, "n long, weights binary").collect()  # a row of 1 MB for each shard
    total = sum(r["n"] for r in found)
    if not total:
        return Model(np.zeros((1 << BUCKET_BITS) + 1, np.float32))
    return Model(sum(np.frombuffer(r["weights"], "<f4") * (r["n"] / total) for r in found).astype(np.float32))


SCORE = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The score of every whole text, and whether it reaches the threshold. No shuffle.

    A row for each row of docs. A text without tokens, or a null one, has the score that the bias alone gives; a null id
    counts as held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each bucket, whatever the corpus

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([shared.value.score(b) for _, _, b in blocks(batch.column(2))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [f.split()[0] for f in SCORE.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, work, SCORE)
