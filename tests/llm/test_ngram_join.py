"""Operator 13 against the Jaccard similarity of all pairs of texts."""

from __future__ import annotations

import random
import re

import pytest

from tests.llm.helpers import EDGES, MIDDLE, ascii_lower, documents, prose
from waymark.llm import ngram_join
from waymark.llm.entries import op13_ngram_jaccard
from waymark.llm.ngram_join import Likeness


def shingles(text: str | None, words: int = 4) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def expected(rows, words: int = 4, part: int = 85, whole: int = 100):
    """(doc_id, size of the set, component) of every row, by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and (a == b or (whole * min(len(a), len(b)) >= part * max(len(a), len(b)) and whole * len(a & b) >= part * len(a | b))):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(s), str(least.get(find(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def planted():
    """Chains of texts with more and more words changed, many copies of one text with some changes each, and texts at the bound."""
    rows, k = [], 100
    for seed in range(12):
        r = random.Random(seed)
        text = prose(seed, r.choice((3, 6, 12, 60, 300))).split()
        for _ in range(12):
            rows.append((k, " ".join(text)))
            k += 1
            for _ in range(max(1, len(text) // 60)):
                text[r.randrange(len(text))] = f"changed{r.randrange(10**6)}"
    for n in range(90):
        text = prose(77, 150).split()
        for m in range(n % 7):
            text[(n * 37 + m * 11) % 150] = f"other{n}"
        rows.append((k + n, " ".join(text)))
    for n, cut in enumerate((84, 85, 86, 87, 88, 89, 100)):
        # A prefix of a text of 103 words has cut of its 100 shingles.
        rows.append((500 + n, " ".join(f"w{j}" for j in range(cut + 3))))
    return rows


def test_planted_and_edges(spark):
    rows = EDGES + planted()
    assert result(ngram_join.jaccard_components(documents(spark, rows))) == expected(rows)
    assert ngram_join.jaccard_components(documents(spark, rows).limit(0)).collect() == []
    alone = [(1, None), (None, ""), (2, " ")]
    assert result(ngram_join.jaccard_components(documents(spark, alone))) == expected(alone)


def test_other_bounds(spark):
    rows = planted()[::2]
    for words, part, whole in ((1, 1, 2), (5, 4, 5), (2, 1, 1)):
        assert result(ngram_join.jaccard_components(documents(spark, rows), Likeness(words, part, whole))) == expected(rows, words, part, whole)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", MIDDLE])
def test_given_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op13_ngram_jaccard(spark, folder)) == expected(rows)


def test_many_pairs_of_one_hub(spark, monkeypatch):
    """A hub whose pairs are split, and keys that many nodes share."""
    monkeypatch.setattr(ngram_join, "PAIRS_A_HUB", 4)
    text = prose(5, 120).split()
    rows = [(0, " ".join(text))] + [(k, " ".join([*text, f"tail{k}"])) for k in range(1, 60)]
    rows += [(100 + k, " ".join([*text[:20], *prose(k, 15).split()])) for k in range(60)]
    assert result(ngram_join.jaccard_components(documents(spark, rows))) == expected(rows)


def test_sql(spark, sf_dir):
    from tests.oracle import connect, spark_rows, sql_rows
    from waymark.llm.entries import ORACLES

    assert spark_rows(op13_ngram_jaccard(spark, sf_dir)) == sql_rows(connect(sf_dir), ORACLES["op13_ngram_jaccard"])
