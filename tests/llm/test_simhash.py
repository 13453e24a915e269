"""Operator 7 against all pairs of fingerprints made by the definition."""

from __future__ import annotations

import random

from tests.llm.helpers import EDGES, documents, fingerprint, groups, prose
from waymark.llm import simhash


def expected(rows):
    values = [fingerprint(t) for _, t in rows]
    first = groups(values)
    least: dict[int, int] = {}
    for (i, _), g in zip(rows, first, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted((str(i), f"{v:016x}", str(least.get(g))) for (i, _), v, g in zip(rows, values, first, strict=True))


def result(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def planted():
    """Chains of texts that differ by a word or two, copies, and texts of their own."""
    rows, k = [], 100
    for seed in range(12):
        text = prose(seed, 900).split()
        for step in range(10):
            rows.append((k, " ".join(text)))
            k += 1
            text[random.Random(k).randrange(len(text))] = "changed"
    rows += [(k + n, prose(3, 900)) for n in range(40)]
    return rows


def test_planted_and_edges(spark):
    rows = EDGES + planted()
    assert result(simhash.near_duplicates(documents(spark, rows))) == expected(rows)


def test_links_reach_two_bits_and_no_more(spark):
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(200)]
    for v in list(values):
        x = v
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
            values.append(x)
    values = list(dict.fromkeys(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    distinct = spark.createDataFrame(signed, "fp long")
    pairs = simhash.links(distinct)
    label = {row["node"] % (1 << 64): row["root"] % (1 << 64) for row in simhash.components(pairs).collect()}
    first = groups(values)
    for i in range(len(values)):
        for j in range(i):
            assert (first[i] == first[j]) == (label.get(values[i], values[i]) == label.get(values[j], values[j]))
    assert all((a["a"] ^ a["b"]) % (1 << 64) and ((a["a"] ^ a["b"]) % (1 << 64)).bit_count() <= 2 for a in pairs.collect())


def test_crowded_buckets_and_candidates_that_are_too_far(spark):
    """Many fingerprints with one segment value, near each other or not: split or compared one by one, the links are the same."""
    r = random.Random(9)
    low = r.getrandbits(32)
    values = [r.getrandbits(32) << 32 | low for _ in range(120)]  # far from each other in the upper segment
    for v in values[:60]:
        values += [v ^ 1 << r.randrange(64), v ^ 1 << r.randrange(32) ^ 1 << r.randrange(32, 64), v ^ 7 << r.randrange(60)]
    values = list(dict.fromkeys(values))
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(3)
    first = groups(values)
    for dense in (1, 40, 10**6):
        pairs = simhash.links(distinct, dense)
        assert all(((a["a"] ^ a["b"]) % (1 << 64)).bit_count() in (1, 2) for a in pairs.collect())
        label = {row["node"] % (1 << 64): row["root"] % (1 << 64) for row in simhash.components(pairs).collect()}
        found: dict[int, int] = {}
        assert [found.setdefault(label.get(v, v), k) for k, v in enumerate(values)] == first


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    rows = EDGES + planted()
    docs = documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    least = {int(i): c for i, _, c in expected(rows) if i != "None"}
    want = sorted({str(i) for i, c in least.items() if str(i) == c} | {"None"})
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_empty_table(spark):
    docs = documents(spark, EDGES).limit(0)
    assert simhash.near_duplicates(docs).collect() == [] and simhash.one_of_each(docs).collect() == []
