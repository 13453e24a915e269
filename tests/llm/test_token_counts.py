"""Operator 1 against another library's encoding and a loop over tokens and lines."""

from __future__ import annotations

import base64

import pytest

from tests.llm.helpers import EDGES, documents, prose
from waymark.llm import token_counts
from waymark.llm.entries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
ROWS = [e for e in EDGES if e[0] != 5] + [
    (30, "one line\nand another\n\n\nlast"),
    (31, "\n"),
    (32, "ends with a newline\n"),
    (33, "a <|endoftext|> marker\r\nand more"),
    (34, "é\n漢字\n\U0001f600\U0001f600\nx"),
    (35, "tabs\t\tand  spaces \n  indented \n\t\n"),
    *[(40 + k, prose(k, 60).replace(" ", "\n", k)) for k in range(8)],
]


@pytest.fixture(scope="module")
def spans():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(text: str) -> list[tuple[int, int]]:
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        out, at = [], 0
        for t in coder.encode_ordinary(text):
            n = len(coder.decode_single_token_bytes(t))
            out.append((owner[at], owner[at + n - 1] + 1))
            at += n
        return out

    return of


def counted(text: str, spans) -> list[tuple[int, int, int, int]]:
    edges = [0]
    for k, c in enumerate(text):
        if c == "\n" and k + 1 < len(text):
            edges.append(k + 1)
    edges.append(len(text))
    n, crossing = [0] * (len(edges) - 1), [0] * (len(edges) - 1)
    for a, b in spans(text):
        held = [max(0, min(b, edges[s + 1]) - max(a, edges[s])) for s in range(len(n))]
        best = held.index(max(held))
        n[best] += 1
        crossing[best] += sum(h > 0 for h in held) > 1
    return [(edges[s], edges[s + 1], n[s], crossing[s]) for s in range(len(n))]


def test_counts(spark, spans):
    want = sorted((str(i), s, *row) for i, t in ROWS for s, row in enumerate(counted(t or "", spans)))
    found = token_counts.section_counts(documents(spark, ROWS), PATH).collect()
    assert sorted((str(r["doc_id"]), r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]) for r in found) == want


def test_very_long_text_adds_up(spark, spans):
    text = EDGES[4][1]
    total = token_counts.document_counts(token_counts.section_counts(documents(spark, [(5, text)]), PATH)).first()
    assert total["n_tokens"] == len(spans(text))


def test_other_sections_and_empty_table(spark):
    thirds = lambda text: [0, len(text) // 3, 2 * len(text) // 3] if len(text) > 3 else [0]
    found = token_counts.section_counts(documents(spark, [(1, "abcdef ghij klm")]), PATH, thirds).collect()
    assert len(found) == 3 and [r["start"] for r in sorted(found, key=lambda r: r["section"])] == [0, 5, 10]
    assert token_counts.section_counts(documents(spark, EDGES).limit(0), PATH).collect() == []


def test_a_tie_goes_to_the_earlier_section():
    import numpy as np

    n, crossing = token_counts.attribute(np.array([[0, 2], [2, 4]]), np.array([0, 3]), 4)
    assert n.tolist() == [2, 0] and crossing.tolist() == [1, 0]
