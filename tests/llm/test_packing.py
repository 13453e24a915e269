"""Operator 3: pieces against the tokenizer itself, layouts by going through them, numbers of sequences against a bound."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import EDGES, documents, prose, sound_layout
from waymark.llm import packing
from waymark.llm.entries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def expected(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((str(i), k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


MORE = [
    (20, "It's we'll THEY'VE don't I'm you'd who're 'sign '' 's"),
    (21, "<|endoftext|> in a text, and <|startoftext|>x <|end oftext|>"),
    (22, "a\x1cb\x1d c\x1e d\x1f"),
    (23, "ΑΣ ΟΔΟΣ İ ǅ ﬁne ① x²  ٣٤ नमस्ते"),
    (24, "1234 12a b34 $5.00 --- ... ,,, a_b a-b x@y.z"),
]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_layout(spark, capacity):
    rows = EDGES + MORE + [(100 + k, prose(k, 1 + 37 * k % 900)) for k in range(150)]
    found = packing.pack(documents(spark, rows), PATH, capacity, rounds=60).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected(rows, capacity)
    histogram: dict[int, int] = {}
    for r in found:
        histogram[r["length"]] = histogram.get(r["length"], 0) + 1
    assert sound_layout(found, capacity) <= 1.02 * packing.lower_bound(histogram, capacity) + 1


def test_gaps_finds_faults(spark):
    sound = spark.createDataFrame([(1, 0, 5), (1, 5, 3), (2, 0, 4)], "sequence_id long, offset long, length long")
    assert packing.gaps(sound).collect() == []
    assert packing.gaps(spark.createDataFrame([(1, 0, 5), (1, 6, 3)], sound.schema)).count() == 1


def test_empty_table(spark):
    assert packing.pack(documents(spark, EDGES).limit(0), PATH).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_holds_every_piece(histogram):
    plan = packing.packing_plan(histogram, 50, rounds=40)
    held: dict[int, int] = {}
    for content, number in plan:
        assert sum(a * b for a, b in content) <= 50 and number > 0
        for a, b in content:
            held[a] = held.get(a, 0) + b * number
    assert held == histogram
    # No two sequences that fit into one are left: at most twice the bound, and one more.
    assert packing.lower_bound(histogram, 50) <= sum(n for _, n in plan) <= 2 * packing.lower_bound(histogram, 50) + 1


def test_pricing_is_an_exact_knapsack():
    r = np.random.default_rng(1)
    price = np.where(r.random(31) < 0.4, r.random(31), 0.0)
    price[0] = 0
    chosen = packing.priced_configuration(price, 30)
    best = np.zeros(31)
    for room in range(1, 31):
        best[room] = max([best[room - 1], *(best[room - a] + price[a] for a in range(1, room + 1) if price[a] > 0)])
    assert sum(price[a] * n for a, n in chosen.items()) == pytest.approx(best[30])


def test_common_words_outlast_words_that_come_once():
    from waymark.llm.bpe import WordIds

    encoder, learned = WordIds(PATH), []
    encoder.most = 400
    learn = encoder.learn
    encoder.learn = lambda new: (learned.extend(new), learn(new))
    common = [f"word{chr(97 + k)}" for k in range(20)]
    for n in range(30):
        texts = [" ".join([*common, *[f"once{n}x{k}, often." for k in range(60)]])]
        assert encoder.texts(texts) == [b"".join(encoder.encoded([t])[0] for t in texts)]
    assert [learned.count(w) for w in common] == [1] * 20
    assert len(encoder.met) + len(encoder.before) <= 2 * 400


def test_words_are_kept_without_signs():
    """A word beside other signs is no new one, and Latin texts of every kind are encoded as the tokenizer does."""
    import random

    from public_tokenizers import path
    from waymark.llm.bpe import WordIds

    encoder = WordIds(path("word_bpe_49k.json"))
    encoder.texts(["Alpha, (alpha) ALPHA.\n\"alpha\" alpha's"])
    assert set(encoder.met) == {"alpha", ",", "(", ")", ".", '"', "'s"}
    r = random.Random(8)
    signs = "aZéÀßÿŁıª²½ºµ×÷'’_-.,;<|>#¡ \t\n\r\x0b\x0c\x85\xa0\x00\x7f059" + "stredvml'"
    texts = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> it's 'S'T", "don't 'start' we'LL x''ll", "ĲǅŉſȺɏ", "İstanbul Σας"]
    texts += ["".join(c + r.choice(["", " ", "a", "'s"]) for c in map(chr, range(0x250)) if not "\x1c" <= c <= "\x1f")]
    right = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = encoder.texts(texts)
    assert [t for t, a, b in zip(texts, found, right, strict=True) if a != b] == []
