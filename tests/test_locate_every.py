"""locate_every against a search for every item in every document."""

from __future__ import annotations

from waymark.queries import QUERIES


def expected(docs, items):
    for d, t in docs:
        for i, e in items:
            if not e.strip():
                continue
            n, m = t.count(e), t.lower().count(e.lower())
            if n == 1:
                yield d, i, "exact", t.find(e)
            elif n == 0 and m == 1:
                yield d, i, "folded", t.lower().find(e.lower())
            elif n or m:
                yield d, i, "ambiguous", None


def test_every_item_in_every_document(spark, tmp_path):
    items = [(k, f"the question of number {k} and no other") for k in range(60)] + [(77, "Twice"), (41, "nowhere at all"), (78, "wice tw"), (79, "ore it the"), (80, "number 7 and no other; then"), (81, "  "), (82, "tWICE and Twic")]
    docs = [(d, f"Before it {items[(d * 7) % 60][1]}; then {items[(d * 11 + 3) % 60][1].upper()} after.") for d in range(50)] + [(90, "Twice and Twice"), (91, "twice"), (92, ""), (93, "twice TWICE")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = [tuple(r) for r in QUERIES["locate_every"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected(docs, items), key=str) and any(i >= 40 for _, i, _, _ in found)
