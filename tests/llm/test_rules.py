"""Operator 6 against its SQL, against a loop over words, and in every order of its rules."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa

from tests.llm.helpers import EDGES, documents, prose
from tests.oracle import connect, spark_rows, sql_rows
from waymark.llm import entries, rules
from waymark.llm.common import blocks

ROWS = EDGES + [
    (20, "a b c d e a b c d e and then some more words here"),
    (21, "same line\nsame line\n  \n\n same line\nother"),
    (22, "# $ * % & | < > #### word word word word word word word word word"),
    (23, "WHY ALL THESE CAPITAL LETTERS IN ONE LONG LINE OF A TEXT?"),
    (24, "no!! no!! no!! stop!! it!! now!! or!! else!! you!! know!!"),
    (25, "the the the cat cat cat sat sat sat on on on a a a mat mat"),
    (26, prose(1, 300)),
    (27, "x\x85y z\xa0w one two three four five six seven eight"),
    (28, "line one\r\nline one\r\nline two and a few more words than ten in all"),
]


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_columns(spark):
    want = sorted((str(i), *base(t)) for i, t in ROWS)
    found = rules.rule_report(documents(spark, ROWS)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert kept[26] and not any(kept[i] for i in (22, 23, 24, 25))


def test_sql(spark, sf_dir):
    assert spark_rows(entries.op6_quality_rules(spark, sf_dir)) == sql_rows(connect(sf_dir), entries.OP6)


def test_order_never_changes_a_verdict():
    (((_, _, block)),) = blocks(pa.array([t for i, t in ROWS if i != 5]))
    every = list(rules.BASE_RULES + rules.TEXT_RULES)
    want = rules.verdicts(rules.TextStats(block), every).tolist()
    for seed in range(6):
        random.Random(seed).shuffle(every)
        assert rules.verdicts(rules.TextStats(block), every).tolist() == want


def test_cheap_and_selective_rules_come_first(spark):
    docs = documents(spark, [(k, "too short") for k in range(50)])
    assert rules.measured_order(docs)[0].name == "few_words"


def test_keep_documents_keeps_rows_as_they_are(spark):
    docs = documents(spark, ROWS)
    kept = rules.keep_documents(docs)
    report = {(str(r["doc_id"])): r["kept"] for r in rules.rule_report(docs).collect()}
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in ROWS if report[str(i)])


def test_empty_table(spark):
    docs = documents(spark, ROWS).limit(0)
    assert rules.rule_report(docs).collect() == [] and rules.keep_documents(docs).collect() == []
