"""The pipeline's near-copy stage against the Jaccard similarity of all pairs of texts."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.helpers import EDGES, MIDDLE, documents, prose


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_ids(rows) -> list:
    """The smallest id of each component of pairs with similarity 0.8 or more, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def planted():
    """Chains of texts with more and more words changed, and copies of one text with a change each."""
    rows, k = [], 100
    for seed in range(12):
        r = random.Random(seed)
        text = prose(seed, r.choice((6, 12, 60, 300))).split()
        for _ in range(12):
            rows.append((k, " ".join(text)))
            k += 1
            for _ in range(max(1, len(text) // 45)):
                text[r.randrange(len(text))] = f"changed{r.randrange(10**6)}"
    for n in range(80):
        text = prose(77, 150).split()
        for m in range(1 + n % 5):
            text[(n * 37 + m * 11) % 150] = f"other{n}"
        rows.append((k + n, " ".join(text)))
    return rows


def test_planted_and_edges(spark):
    rows = EDGES + planted()
    docs = documents(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == first_ids(rows) and None in ids
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_rows_are_judged_not_ids(spark):
    """An id with several texts: each row goes or stays by its own text."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, b), (5, a), (5, b), (6, c), (6, c), (6, c + " more"), (7, c), (None, a), (8, None), (9, "")]
    for one in (rows, rows[::-1]):
        kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, documents(spark, one), "").collect()]
        assert sorted(i or 0 for i, _ in kept) == [0, 1, 5, 6, 8]
        assert {(1, b), (5, a), (None, a), (8, None)} < set(kept)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", MIDDLE])
def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).select("doc_id").collect()) == first_ids(rows)
