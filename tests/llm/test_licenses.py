"""Operator 8 against a loop over the words of each text."""

from __future__ import annotations

import random
import re

from tests.llm.helpers import EDGES, ascii_lower, documents, prose
from waymark.llm import licenses

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

ROWS = EDGES + [
    (20, "MIT License. mit\nLICENSE mit-license MITlicense mit  license"),
    (21, "Licensed under the Apache License, Version 2.0 (the same)."),
    (22, "This is under the GNU General Public License, and the general public license again"),
    (23, "mit é license; mité license"),
    (24, "mit license" * 3),
    (25, prose(1, 300) + " Licensed under CC BY-NC 4.0 " + prose(2, 300)),
    (26, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, and associated docs files"),
    (27, " ".join(["mit license"] * 5000)),
    (28, "general public general public license license mit apache license"),
    (29, prose(5, 2000)),
]


def expected(rows):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
        at = [(k, label) for label, phrase in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        out.append((str(i), len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=str)


def test_base_columns(spark):
    found = licenses.license_report(documents(spark, ROWS)).collect()
    assert sorted(((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=str) == expected(ROWS)
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_templates(spark):
    by = {r["doc_id"]: r for r in licenses.license_report(documents(spark, ROWS)).collect()}
    assert "cc-by-nc" in by[25]["labels"] and "apache" in by[21]["labels"] and by[21]["score"] == 1.0
    assert by[26]["labels"] == "mit" and by[26]["base_labels"] == "" and 0.5 <= by[26]["score"] < 1
    assert by[29]["labels"] == "" and by[29]["score"] == 0.0


def test_spans_merge_neighbouring_diagonals(spark):
    template = licenses.TEMPLATES[1][1].split()
    text = " ".join([*prose(3, 40).split(), *template[:9], "really", *template[9:], *prose(4, 40).split()])
    rows = [r for r in licenses.spans(documents(spark, [(1, text)])).collect() if r["template"] == len(licenses.BASE_PHRASES) + 1]
    assert len(rows) == 1 and rows[0]["first"] == 40


def test_empty_table(spark):
    assert licenses.license_report(documents(spark, EDGES).limit(0)).collect() == []


def test_spans_are_verified(spark):
    notice = "under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cc = "Licensed under a Creative Commons Attribution{} 4.0 International License"
    rows = [
        (1, notice.format("")), (2, notice.format("Lesser ")), (3, notice.format("Affero ")), (4, " ".join(["this software for any and"] * 40)), (5, cc.format("")), (6, cc.format("-NonCommercial")),
        (7, "Licensed under CC BY-NC-SA 4.0"), (8, "documentation files software and associated of this a copy obtaining to any person of charge free granted hereby is Permission"),
        (9, " filler ".join("this is free and|free and unencumbered software|software released into the|into the public domain".split("|")) + prose(1, 90)),
    ]
    by = {r["doc_id"]: r["labels"] for r in licenses.license_report(documents(spark, rows)).collect()}
    assert by == {1: "gpl", 2: "gpl,lgpl", 3: "agpl,gpl", 4: "", 5: "cc-by", 6: "", 7: "", 8: "", 9: ""}


def by_loop(text):
    """labels and score from the definition: for each template and band of diagonals the longest run in order, by trying all."""
    from waymark.llm.licenses import BASE_PHRASES, GAP, GRAM, LEAST_SHARE, TELLING, TEMPLATES, WHOLE

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    labels, score = {x for x, p in PHRASES.items() if f" {p} " in f" {' '.join(words)} "}, 0.0
    score = 1.0 if labels else 0.0
    assert {x for x, _ in BASE_PHRASES} == set(PHRASES)
    for label, template in TEMPLATES + WHOLE:
        own = re.findall(r"[a-z0-9]+", template.lower())
        grams = [own[k : k + GRAM] for k in range(len(own) - GRAM + 1)]
        telling = [w.split() for w in TELLING.get(label, "").split("|") if w]
        hits = [(p, a) for p in range(len(words) - GRAM + 1) for a, g in enumerate(grams) if words[p : p + GRAM] == g]
        for band in {(p - a) // GAP - d for p, a in hits for d in (0, 1)}:
            near = sorted(h for h in hits if (h[0] - h[1]) // GAP in (band, band + 1))
            best: list[list] = []
            for k, (p, a) in enumerate(near):
                best.append(max(([*best[j], (p, a)] for j in range(k) if near[j][0] < p and near[j][1] < a), key=len, default=[(p, a)]))
            run = max(best, key=len)
            told = not telling or any(any(own[k : k + len(w)] == w for k in range(a, a + GRAM - len(w) + 1)) for _, a in run for w in telling)
            if len(run) >= LEAST_SHARE * len(grams) and told:
                labels.add(label)
                score = max(score, len(run) / len(grams))
    return ",".join(sorted(labels)), score


def test_labels_and_score_by_brute_force(spark):
    from waymark.llm.licenses import TEMPLATES, WHOLE

    r = random.Random(2)
    rows = [(k, t) for k, t in ROWS if t is None or len(t) < 20_000]
    for k, (_, template) in enumerate(TEMPLATES + WHOLE):
        words = template.split()
        cut = [w for w in words if r.random() > 0.06]
        grown = [x for w in words for x in ([w, "really"] if r.random() < 0.05 else [w])]
        rows += [(100 + k, template), (200 + k, f"{prose(k, 30)} {' '.join(cut)} {prose(k + 50, 20)}"), (300 + k, " ".join(grown)), (400 + k, " ".join(words[: len(words) * 2 // 3])), (500 + k, " ".join(words[len(words) // 2 :] + words[: len(words) // 2]))]
    found = licenses.license_report(documents(spark, rows)).collect()
    got = sorted((str(f["doc_id"]), f["labels"], round(f["score"], 9)) for f in found)
    assert got == sorted((str(i), *(lambda v: (v[0], round(v[1], 9)))(by_loop(t))) for i, t in rows)


def test_one_scan(spark, tmp_path):
    """The texts are read once: what follows reads the votes that were written."""
    documents(spark, ROWS).write.parquet(str(tmp_path / "docs"))
    plan = licenses.license_report(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan ExistingRDD" in plan
