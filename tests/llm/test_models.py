"""Operators 4 and 9: accuracy on documents that nothing was learned from, and what odd rows get."""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EDGES, MIDDLE, documents
from waymark.llm import langid, quality_model
from waymark.llm.common import blocks

pytestmark = pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="the driver's tables aren't here")


def held(i) -> bool:
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


@pytest.fixture(scope="module")
def languages(tables):
    return langid.train(tables[0])


@pytest.fixture(scope="module")
def quality(tables):
    return quality_model.train(*tables)


def test_languages_of_held_out_documents(tables, languages):
    docs = tables[0]
    found = langid.identify(docs, languages)
    rows = found.join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and length(text) > 40").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert found.count() == docs.count() and all(r["held_out"] == held(r["doc_id"]) for r in found.collect())


def test_language_of_odd_rows(spark, languages):
    rows = {str(r["doc_id"]): r for r in langid.identify(documents(spark, EDGES), languages).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in ("1", "2", "3", "8", "9"))
    assert rows["5"]["lang_pred"] in languages.languages and rows["None"]["held_out"]
    assert langid.identify(documents(spark, EDGES), languages).count() == len(EDGES)


def test_labels_texts_and_held_out_rows_never_reach_a_prediction(tables, languages):
    docs = tables[0]
    other = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("elsewhere")})
    again = langid.train(other)
    assert again.languages == languages.languages and np.array_equal(again.gram, languages.gram)


def test_no_language_to_learn(spark, tables):
    none = langid.train(tables[0].withColumn("lang", F.lit(None).cast("string")))
    assert none is None
    assert {r["lang_pred"] for r in langid.identify(documents(spark, EDGES), none).collect()} == {"und"}
    assert langid.keep_identified(documents(spark, EDGES), none).count() == len(EDGES)  # nothing to judge by
    assert langid.train(documents(spark, EDGES).limit(0)) is None


def test_keep_identified_keeps_rows_as_they_are(tables, languages):
    docs = tables[0]
    kept = langid.keep_identified(docs, languages)
    assert kept.schema == docs.schema
    want = langid.identify(docs, languages).where("lang_pred <> 'und' and score >= 0.5").select("doc_id")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want.collect())


def test_quality_of_held_out_documents(tables, quality):
    docs, labels = tables
    rows = quality_model.score(docs, quality).join(labels, "doc_id").where("held_out").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert len(good) > 10 and len(bad) > 10
    auc = np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :])
    assert auc > 0.85


def test_quality_of_odd_rows(spark, quality):
    rows = quality_model.score(documents(spark, EDGES), quality).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"]) for r in rows)
    assert quality_model.score(documents(spark, EDGES).limit(0), quality).collect() == []


def test_quality_learns_nothing_from_held_out_labels(tables, quality):
    docs, labels = tables
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_model.train(docs, flipped).weights, quality.weights)


def test_no_labels(spark, tables):
    model = quality_model.train(tables[0], tables[1].limit(0))
    assert {r["score"] for r in quality_model.score(documents(spark, EDGES), model).collect()} == {0.5}


def test_ftrl_follows_its_closed_form():
    model = quality_model.Ftrl()
    model.update(np.array([3]), np.array([2.0]), 1)
    g = (0.5 - 1) * 2.0
    assert model.z[3] == g and model.n[3] == g * g
    want = -(g - np.sign(g) * quality_model.L1) / ((quality_model.BETA + abs(g)) / quality_model.ALPHA + quality_model.L2)
    assert model.weights()[3] == pytest.approx(want)


def naive_bayes(rows):
    """Counts, priors and log probabilities of (text, lang) rows, gram by gram."""
    counts: dict[str, dict[int, int]] = {}
    for text, lang in rows:
        mine = counts.setdefault(lang, {})
        for b in buckets_of(text):
            mine[b] = mine.get(b, 0) + 1
    total = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    return lambda lang, b: math.log((counts[lang].get(b, 0) + 0.5) / total[lang])


def buckets_of(text):
    """The bucket of every n-gram of the letters, words parted by one space."""
    letters = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " "
    letters = re.sub(" +", " ", letters)
    for n in langid.ORDERS:
        for k in range(len(letters) - n + 1):
            h = n
            for c in letters[k : k + n]:
                h = (h * 0x01000193 % 2**32) ^ ord(c)
            h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
            yield (h ^ h >> 13) % langid.BUCKETS


def test_language_model_against_plain_loops(spark):
    known = [(k, t, lang) for k, (t, lang) in enumerate([("the river and the stone", "en"), ("der Fluss und der Stein", "de"), ("the lamp, the lamp", "en"), ("la rivière et la pierre", "fr"), ("ein Haus am See", "de"), ("one more line of words", "en"), ("zwei Dinge", "de"), ("trois choses à voir", "fr")] * 2)]
    docs = spark.createDataFrame(known, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs)
    learned = [(t, lang) for k, t, lang in known if not held(k)]
    log_p = naive_bayes(learned)
    n = {lang: sum(x == lang for _, x in learned) for lang in model.languages}
    assert set(n) == {lang for _, lang in learned}
    tried = ["the stone", "der See", "la pierre", "une chose", "?", "Größe"]
    found = langid.identify(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).collect()
    for r in found:
        text = tried[r["doc_id"]]
        sums = {x: math.log(n[x] / sum(n.values())) + langid.TEMPER * sum(log_p(x, b) for b in buckets_of(text)) for x in model.languages}
        if any(c.isalpha() for c in text):
            best = max(sums.values())
            assert sums[r["lang_pred"]] == pytest.approx(best, abs=1e-3)
            assert r["score"] == pytest.approx(1 / sum(math.exp(v - best) for v in sums.values()), abs=1e-3)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_rare_languages_and_ties(spark):
    rows = [(k, "the river and the stone", "en") for k in range(4000)] + [(10_000 + k, "der Fluss und der Stein", "de") for k in range(8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert model.languages == ("de", "en") and model.prior[1] > model.prior[0]
    same = langid.Model(("aa", "bb"), np.zeros((langid.BUCKETS, 2), np.float32), np.log(np.array([0.5, 0.5])))
    assert [r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), same).collect()] == ["aa"]


def test_quality_model_against_plain_loops(spark):
    texts = [f"{'good plain words of prose' if k % 3 else 'buy buy now !!! now'} number {k % 7}" for k in range(90)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(5, None), (5, texts[5])], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(90)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    ids = spark.createDataFrame([(k,) for k in range(90) if not held(k)], "doc_id long").repartition(quality_model.SHARDS, F.xxhash64("doc_id"))
    shards: dict[int, list[int]] = {}
    for r in ids.select("doc_id", F.spark_partition_id().alias("shard")).collect():
        shards.setdefault(r["shard"], []).append(r["doc_id"])
    a, b, l1, l2 = quality_model.ALPHA, quality_model.BETA, quality_model.L1, quality_model.L2

    def vector(text):
        ((_, _, block),) = blocks(pa.array([text]))
        found = quality_model.features(block)[0].tolist()
        return {x: found.count(x) * quality_model.SCALE / len(found) for x in found} | {-1: 1.0}

    def weight(z, n):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((b + math.sqrt(n)) / a + l2)

    total: dict[int, float] = {}
    learned = sum(map(len, shards.values()))
    for mine in shards.values():
        z, n = {}, {}
        mine.sort(key=lambda k: (k * 0x9E3779B97F4A7C15) % (1 << 64))
        for k in mine * quality_model.PASSES:
            x = vector("" if k == 5 else texts[k]) if k != 5 else {-1: 1.0}  # of a repeated id the text that sorts first
            p = 1 / (1 + math.exp(-sum(weight(z.get(f, 0.0), n.get(f, 0.0)) * v for f, v in x.items())))
            for f, v in x.items():
                g, w = (p - int(k % 3 > 0)) * v, weight(z.get(f, 0.0), n.get(f, 0.0))
                s = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / a
                z[f], n[f] = z.get(f, 0.0) + g - s * w, n.get(f, 0.0) + g * g
        for f in z:
            total[f] = total.get(f, 0.0) + weight(z[f], n[f]) * len(mine) / learned
    assert all(model.weights[f] == pytest.approx(w, abs=1e-4) for f, w in total.items())
    assert np.count_nonzero(model.weights) == sum(abs(w) > 0 for w in total.values())
    for r in quality_model.score(spark.createDataFrame([(k, texts[k]) for k in range(9)], "doc_id long, text string"), model).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(total.get(f, 0.0) * v for f, v in vector(texts[r["doc_id"]]).items()))), abs=1e-4)
