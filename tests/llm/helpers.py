"""Small tables for the text operators, and plain-Python versions of what they compute."""

from __future__ import annotations

import random
import re

MIDDLE = "/root/testdata/sf0.01"

WORDS = "river stone lamp garden window quiet morning carries letter between harbour engine winter bread silver market distant music paper forest singing neighbour".split()

#: Columns that clash with names the operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row long, label string, n long, a string, b long, fp long, node long, root long, rank int, bucket int, _gone long, fingerprint string, score double"

EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n \r\x0b\x0c "),
    (4, "word"),
    (5, " ".join(WORDS[(k * k + k // 7) % len(WORDS)] + str(k % 977) for k in range(60_000))),
    (6, "The same short text stands here twice, in two rows with one id."),
    (6, "The same short text stands here twice, in two rows with one id."),
    (None, "A text in a row that has no id at all, with a few more words."),
    (7, "naïve Größe ÇA İstanbul 漢字 \U0001f600 é done now"),
    (8, "123 456 !!! ??? 7.8"),
    (9, None),
]


def documents(spark, rows, lang="en"):
    """A documents table of (doc_id, text) rows with further columns."""
    made = [(i, t, lang, "src", None if t is None else len(t), 1, "x", 2, "y", 3, 4, 5, 6, 7, 8, 9, "z", 0.5) for i, t in rows]
    return spark.createDataFrame(made, CLASHING).repartition(3)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.6 else "") for _ in range(n))


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None) -> int:
    """By the definition: a bit is set if it is in over half the shingles' hashes."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values: list[int], most: int = 2) -> list[int]:
    """For each value the index of the first that can be reached over links of so many bits, by comparing all pairs."""
    root = list(range(len(values)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(values))]


def sound_layout(rows, capacity: int = 2048) -> int:
    """The number of sequences, after checking that each is gapless from 0 and within the capacity."""
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)
