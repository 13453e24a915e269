"""Operator 12 against a full eigendecomposition of the covariance, and its rank-one updates alone."""

from __future__ import annotations

import math

import numpy as np
import pytest

from waymark.llm import whitening
from waymark.llm.entries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def expected(rows):
    """(id, n, deviation) of each row, the fit list's eigenvalues from the largest, and its eigenvectors in rows."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    listed = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(listed), listed.sum(0).tolist()
    away = (listed - np.array([s / n for s in sums], dtype=object)).astype(float)
    values, vectors = np.linalg.eigh(away.T @ away / n)
    out = [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.array(x) - np.array(sums) / n) for i, x in good]
    return out, values[::-1], vectors[:, ::-1].T


def check(found, rows):
    want, values, vectors = expected(rows)
    k = min(4, len(values))
    assert len(found) == k * len(want)
    by: dict = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
    for c in range(1, k + 1):
        got = sorted(by[c], key=lambda r: (str(r["vec_id"]), r["deviation"]))
        made = sorted(want, key=lambda w: (str(w[0]), w[2]))
        assert [(r["vec_id"], r["n"], r["deviation"]) for r in got] == [w[:3] for w in made]
        plain = np.array([w[3] @ vectors[c - 1] / math.sqrt(values[c - 1]) for w in made])
        ours = np.array([r["whitened"] for r in got])
        sign = np.sign(plain @ ours)
        assert np.allclose(ours, sign * plain, rtol=0, atol=1e-7)
        assert all(r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) for r in got)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_given_embeddings(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op12_embedding_whitening(spark, sf_dir).collect(), rows)


def test_edges(spark):
    r = np.random.default_rng(3)
    rows = [(k, (r.normal(size=6) * [4, 3, 2, 1, 0.5, 0.2]).tolist()) for k in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0, 0]), (103, [1.0, math.nan, 0, 0, 0, 0]), (104, [math.inf] * 6), (None, [-0.0] * 6), (3, rows[3][1]), (3, rows[3][1]), (7, rows[8][1])]
    check(whitening.whiten(table(spark, rows + odd)).collect(), rows + odd)
    narrow = [(105, [1.0, 2.0]), (106, [0.0] * 7)]
    check(whitening.whiten(table(spark, rows + odd + narrow)).collect(), rows + odd)
    assert whitening.whiten(table(spark, rows).limit(0)).collect() == []
    assert whitening.whiten(table(spark, odd[:5])).collect() == []


def test_without_variance(spark):
    alone = whitening.whiten(table(spark, [(1, [1.5, 2.5, 0.1])] * 3)).collect()
    assert len(alone) == 9 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone} == {(1, 0, None, 0.0, None)}
    line = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k]) for k in range(5)])).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 2} == {True}
    assert all(r["explained"] == pytest.approx(1) and r["identity_error"] < 1e-9 for r in line if r["component"] == 1)
    two = whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 3e30])])).collect()
    assert len(two) == 4 and {r["deviation"] for r in two} == {None}


@pytest.mark.parametrize("width", [1, 2, 5, 40])
def test_rank_one_updates_and_combinations(width):
    r = np.random.default_rng(width)
    rows = np.floor(r.normal(size=(120, width)) * r.integers(1, 200, width))
    rows[10:30] = rows[9]
    rows[:, width // 2 :] *= r.integers(0, 2, size=(120, 1))
    parts = [whitening.Spectrum.empty(width) for _ in range(4)]
    for k, x in enumerate(rows):
        parts[k % 3].add(x)
    whole = whitening.Spectrum.empty(width)
    for p in parts:
        whole.combine(whitening.Spectrum.of(p.flat(), width))
    away = rows - rows.mean(0)
    scatter = away.T @ away
    assert whole.n == 120 and np.allclose(whole.mean, rows.mean(0))
    size = max(1.0, float(np.abs(scatter).max()))
    assert np.allclose(whole.vectors.T @ whole.vectors, np.eye(width), atol=1e-10)
    assert np.allclose(whole.vectors * whole.values @ whole.vectors.T, scatter, atol=1e-10 * size)
    assert np.allclose(whole.values, np.linalg.eigvalsh(scatter), atol=1e-10 * size)
