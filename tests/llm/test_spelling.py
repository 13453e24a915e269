"""Operator 11 against edits tried out letter by letter, and its trees against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import EDGES, ascii_lower, documents, prose
from waymark.llm import spelling
from waymark.llm.entries import op11_spelling_variants


def counted(rows):
    n: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def expected(rows):
    n = counted(rows)
    gaps = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k] + "_" + w[k + 1 :]].add(w)
            gaps[w[:k] + w[k + 1 :]].add(w) if w[:k] + w[k + 1 :] in n else None
    near = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            near[w] |= gaps[w[:k] + "_" + w[k + 1 :]] - {w}
        near[w] |= gaps.get(w, set()) - {w}
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def planted():
    r = random.Random(4)
    rows, k = [], 100
    for word, n in (("lighthouse", 400), ("lighthouze", 30), ("lighthouzee", 2), ("lighthose", 40), ("ligthhouse", 5), ("café" + "étage", 60), ("cafeétage", 6), ("élévationé", 20), ("elévationé", 2), ("aaaaaaa", 50), ("aaaaaaab", 5), ("abababa", 20), ("bababab", 20), ("bababac", 2)):
        for _ in range(n):
            rows.append((k, f"{r.choice(['The ', '', '12'])}{word.upper() if r.random() < 0.2 and word.isascii() else word}-x"))
            k += 1
    rows += [(k + 1, "x" * 7_000), (k + 2, "x" * 7_000), (k + 3, "x" * 6_999 + " " + "x" * 6_999), (k + 4, "×ab÷cdefg ×ab÷cdefg Āabcdefghā abcdefgh")]
    return rows


def test_planted_and_edges(spark):
    rows = EDGES + planted() + [(k, prose(k, 400)) for k in range(900, 930)]
    assert result(spelling.spelling_variants(documents(spark, rows))) == expected(rows)
    assert spelling.spelling_variants(documents(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op11_spelling_variants(spark, folder)) == expected(rows)


def test_cut_and_dealt_leaves(spark, monkeypatch):
    """Small leaves and tasks, so that words are cut apart by a sample, and words of the same letters are dealt to several."""
    monkeypatch.setattr(spelling, "SAMPLE", 200)
    monkeypatch.setattr(spelling, "LEAF", 40)
    monkeypatch.setattr(spelling, "MOST", 16)
    r = random.Random(9)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(7, 9))) for _ in range(700)] + ["".join(r.sample("abcdefg", 7)) for _ in range(200)]
    rows = [(k, " ".join(r.choices(words, k=80) + ["abcdefg"] * 9)) for k in range(60)]
    assert result(spelling.spelling_variants(documents(spark, rows))) == expected(rows)


def test_trees_reach_all():
    r = np.random.default_rng(1)
    entries = r.integers(0, 4, size=(500, spelling.SLOTS)).astype(np.int16) * (r.random((500, spelling.SLOTS)) < 0.15)
    queries = entries[:100].copy()
    queries[np.arange(100), r.integers(0, spelling.SLOTS, 100)] += 1
    for cells in (False, True):
        tree = spelling.Tree(entries, 8, cells)
        assert sorted(np.concatenate(tree.members).tolist()) == list(range(500))
        for more, less in ((0, 0), (1, 0), (1, 1), (0, 1)):
            who, leaf = tree.reach(queries, more, less)
            found = {(int(w), int(k)) for w, a in zip(who, leaf, strict=True) for k in tree.members[a]}
            for i, q in enumerate(queries):
                d = entries - q
                for k in np.flatnonzero((np.maximum(d, 0).sum(1) <= more) & (np.maximum(-d, 0).sum(1) <= less)):
                    assert (i, int(k)) in found
    who, _ = spelling.Tree(entries, 8, True).reach(entries, 0, 0)
    assert sorted(who.tolist()) == list(range(500))


def test_sql(spark, sf_dir):
    from tests.oracle import connect, spark_rows, sql_rows
    from waymark.llm.entries import ORACLES

    assert spark_rows(op11_spelling_variants(spark, sf_dir)) == sql_rows(connect(sf_dir), ORACLES["op11_spelling_variants"])


def test_few_pairs_are_compared_letter_by_letter(monkeypatch):
    """Words of the same letters share their vector; only those that share a half go to the letters, and none that is near is lost."""
    r = random.Random(3)
    words = sorted({"".join(r.sample("abcdefgh", 8)) for _ in range(400)} | {"".join(r.choices("abcdé", k=8)) for _ in range(400)})
    shorter = sorted({w[:k] + w[k + 1 :] for w in words for k in (0, 3, 4, 7)})
    compared, one_edit = [], spelling._one_edit
    monkeypatch.setattr(spelling, "_one_edit", lambda a, b: compared.append(len(a)) or one_edit(a, b))
    leaf = spelling._Leaf(words, [1] * len(words))
    for queries in (words, shorter):
        who, what = leaf.near(queries)
        found = {(queries[i], words[k]) for i, k in zip(who.tolist(), what.tolist(), strict=True)}
        if queries is words:
            assert found == {(a, b) for a in words for b in words if a < b and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
        else:
            assert found == {(a, b) for b in words for a in {b[:k] + b[k + 1 :] for k in range(len(b))} & set(shorter)}
    assert sum(compared) < 40_000
