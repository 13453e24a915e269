"""The pipeline's stages against plain versions of each, every one on what its predecessor kept."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.helpers import EDGES, documents, prose, sound_layout
from tests.llm.test_decontam import fewest_edits, form
from tests.llm.test_near_copies import first_ids
from tests.oracle import connect
from waymark.llm import decontam, entries, langid


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs)
    return found


def ids(df) -> list:
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "decontamination", "best_fit_packing"]
    assert all(d.columns == stages[0].columns for d in stages[:5])


def test_quality_rules(stages, sf_dir):
    kept = connect(sf_dir).execute(f"SELECT doc_id FROM ({entries.OP6}) WHERE kept ORDER BY 1").fetchall()
    assert ids(stages[1]) == [r[0] for r in kept]


def test_language(stages):
    before = stages[1]
    model = langid.train(before)
    texts = [(r["doc_id"], r["text"]) for r in before.collect()]
    best, score = model.score([t or "" for _, t in texts])
    assert ids(stages[2]) == sorted(i for (i, _), b, s in zip(texts, best, score, strict=True) if b >= 0 and s >= 0.5)


def test_near_duplicates(stages):
    assert ids(stages[3]) == first_ids([(r["doc_id"], r["text"]) for r in stages[2].collect()])


def test_decontamination(stages, spark, sf_dir):
    items = [form(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    budgets = [int(decontam.edit_budget(__import__("numpy").array([len(t)]))[0]) for t in items]
    clean = []
    for r in stages[3].collect():
        text = form(r["text"])
        grams = {text[k : k + 4] for k in range(len(text))}
        # Only documents that share a few short stretches with an item can hold it: the rest needs no alignment.
        near = [(t, b) for t, b in zip(items, budgets, strict=True) if sum(t[k : k + 4] in grams for k in range(0, len(t) - 3, 4)) >= len(t) // 4 - 1 - 2 * b]
        if not any(fewest_edits(t, text) <= b for t, b in near):
            clean.append(r["doc_id"])
    assert ids(stages[4]) == sorted(clean)


def test_packing(stages, spark, sf_dir):
    packed = stages[5].collect()
    assert sorted({r["doc_id"] for r in packed}) == ids(stages[4]) and sound_layout(packed) > 0
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def corpus(spark, folder, docs) -> str:
    docs.write.parquet(str(folder / "documents.parquet"))
    items = [(1, prose(5, 30)), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_odd_rows_clashing_columns_and_an_empty_table(spark, tmp_path):
    rows = [*EDGES, (20, prose(1, 80)), (20, prose(1, 80)), (21, prose(1, 80)), (None, prose(2, 80)), (22, f"{prose(3, 40)} {prose(5, 30)} {prose(4, 40)}"), (23, prose(6, 80))]
    (tmp_path / "a").mkdir()
    found = corpus_pipeline.run(spark, corpus(spark, tmp_path / "a", documents(spark, rows))).collect()
    ids = {r["doc_id"] for r in found}
    assert {20, 23, None} <= ids and not ids & {1, 2, 3, 4, 8, 9, 21, 22}
    assert sum(r["doc_id"] == 20 for r in found) == 1
    (tmp_path / "b").mkdir()
    assert corpus_pipeline.run(spark, corpus(spark, tmp_path / "b", documents(spark, rows).limit(0))).collect() == []
