"""Operator 10 against the edit distance of every item to every place of every document."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from tests.llm.helpers import EDGES, documents, prose
from waymark.llm import decontam

ITEMS = [(k, prose(900 + k, 12 + 5 * k)) for k in range(8)] + [(20, None), (21, ""), (22, "short"), (3, "Ünïcode  ITEM\twith 漢字漢字漢字漢字 and some more of it")]


def edited(text: str, n: int, seed: int) -> str:
    r, out = random.Random(seed), list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        r.choice([lambda: out.__setitem__(k, "q"), lambda: out.insert(k, "z"), lambda: out.pop(k)])()
    return "".join(out)


def corpus():
    rows, k = list(EDGES), 100
    for _, item in ITEMS:
        for share in (0.0, 0.04, 0.08, 0.2, 0.5):
            if item and len(item) > 20:
                rows.append((k, f"{prose(k, 40)} {edited(item, int(share * len(item)), k)} {prose(k + 1, 30)}"))
                k += 1
    rows.append((k, ITEMS[2][1].upper().replace(" ", "\n  ")))
    rows.append((k + 1, f"{ITEMS[1][1]} {prose(7, 5)} {ITEMS[1][1]}"))
    return [r for r in rows if r[0] != 5]


def form(text: str) -> str:
    return " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in text).split())


def fewest_edits(pattern: str, text: str) -> int:
    points = np.array([ord(c) for c in text], dtype=np.int64)
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (points != ord(c)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_every_match_and_no_other(spark):
    rows = corpus()
    want = set()
    for i, text in rows:
        for item_id, item in ITEMS:
            m = len(form(item or ""))
            if 0 < m < decontam.Q:
                if re.search(rf"(?<![^\W_]){re.escape(form(item))}(?![^\W_])", form(text or "")):
                    want.add((str(i), item_id))
            elif m:
                budget = int(decontam.edit_budget(np.array([m]))[0])
                if fewest_edits(form(item), form(text or "")) <= budget:
                    want.add((str(i), item_id))
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, doc_id long, label string")
    found = decontam.contaminations(documents(spark, rows), benchmark).collect()
    assert {(str(r["doc_id"]), r["item_id"]) for r in found} == want and len(want) > 20
    texts = {str(i): t for i, t in rows}
    items = {i: [t for j, t in ITEMS if j == i] for i, _ in ITEMS}
    for r in found:
        part = form(texts[str(r["doc_id"])][r["start"] : r["end"]])
        assert any(fewest_edits(form(t), part) <= r["edits"] for t in items[r["item_id"]] if t) and 0 < r["similarity"] <= 1
    clean = decontam.keep_clean(documents(spark, rows), benchmark)
    assert clean.schema == documents(spark, rows).schema
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if not any(str(i) == d for d, _ in want))


def test_both_places_are_found(spark):
    (item_id, item), = [ITEMS[1]]
    text = f"{item} {prose(7, 400)} {item}"
    found = decontam.contaminations(documents(spark, [(1, text)]), spark.createDataFrame([(item_id, item)], "item_id long, text string")).collect()
    assert sorted((r["start"], r["end"], r["edits"]) for r in found) == [(0, len(item), 0), (len(text) - len(item), len(text), 0)]


def test_very_long_text(spark):
    text = EDGES[4][1]
    item = ITEMS[5][1]
    docs = documents(spark, [(5, f"{text} {item} {text}"), (6, text)])
    found = decontam.contaminations(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["edits"]) for r in found] == [(5, len(text) + 1, 0)]


@pytest.mark.parametrize("block", [1, 60, 10_000])
def test_blocks_of_items(spark, block):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    blocks = list(decontam.item_blocks(benchmark, block))
    assert sorted(i for b in blocks for i in b.ids) == sorted(i for i, t in ITEMS if t)


def test_several_blocks_give_what_one_gives(spark, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, corpus())
    rows = lambda df: sorted(map(str, df.collect()))
    want, clean = rows(decontam.contaminations(docs, benchmark)), rows(decontam.keep_clean(docs, benchmark))
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (150,))
    assert rows(decontam.contaminations(docs, benchmark)) == want and rows(decontam.keep_clean(docs, benchmark)) == clean


def places(item: str, text: str, budget: int) -> list[tuple[int, int, int]]:
    """By the whole table of the alignment: for each end the fewest edits and the latest start, then what doesn't overlap."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for c in item:
        new = [(row[0][0] + 1, row[0][1])]
        for j in range(1, len(text) + 1):
            new.append(min((row[j - 1][0] + (text[j - 1] != c), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    return decontam.apart([(e, -s, j) for j, (e, s) in enumerate(row) if e <= budget and -s < j])


def test_places_against_the_whole_table():
    r, seen = random.Random(1), 0
    for trial in range(150):
        letters = "ab " if trial % 3 == 0 else "abcdefgh "
        n = r.choice((9, 16, 25, 40, 60))
        item = " ".join((("ab " * 20)[:n] if trial % 5 == 0 else "".join(r.choice(letters) for _ in range(n))).split())
        if len(item) < decontam.Q:
            continue
        text = "".join(edited(item, r.randint(0, 5), trial * 7 + k) + "".join(r.choice(letters) for _ in range(r.randint(0, 30))) for k in range(r.randint(1, 4)))
        index = decontam.Index([1], [item])
        form_of = lambda x: "".join(map(chr, decontam.folded([x])[0]))
        points, starts, _ = decontam.folded(["before", text, ""])
        got = decontam.apart(index.found(points, starts).get((1, 0), []))
        assert got == places(item, form_of(text), int(index.budget[0]))
        seen += len(got)
    assert seen > 100


def test_short_items_stand_as_whole_words_and_periodic_ones_at_every_place():
    assert list(decontam.Index([1], ["2+2=4"]).matches(["xx 2+2=4 yy", "12+2=4", "2+2=4", "2+2=45"])) == [(0, 0, 3, 8, 0), (2, 0, 0, 5, 0)]
    assert [(a, b) for _, _, a, b, _ in decontam.Index([1], ["ab " * 12]).matches(["ab " * 60])] == [(k, k + 35) for k in range(0, 180, 36)]


def test_many_items_with_one_stem():
    r = random.Random(1)
    tail = lambda: "".join(r.choice("abcdefghij ") for _ in range(60))
    stem = "Please read the following question carefully and choose the best answer from the options: "
    items = [stem + tail() for _ in range(4000)]
    index = decontam.Index(list(range(4000)), items)
    text = "".join(stem + tail() for _ in range(16)) + items[17]
    began = time.perf_counter()
    assert [(k, e) for _, k, _, _, e in index.matches([text])] == [(17, 0)]
    assert time.perf_counter() - began < 20


def test_empty_tables(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, EDGES)
    assert decontam.contaminations(docs.limit(0), benchmark).collect() == []
    assert decontam.contaminations(docs, benchmark.limit(0)).collect() == []
    assert decontam.keep_clean(docs, benchmark.limit(0)).count() == len(EDGES)
