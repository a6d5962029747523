"""Neighbours by angle against all pairs."""

import numpy as np
import pytest

from hopweave.operators import angular as A


def plain(rows, asked, k, least=None):
    m = np.array([v for _, v in rows], float)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score, out = np.round(u @ u.T, 6), {}
    for i, (a, _) in enumerate(rows):
        if a in asked:
            best = sorted((-score[i, j], b) for j, (b, _) in enumerate(rows) if b != a and (least is None or score[i, j] >= least))[:k]
            out |= {(a, r): (b, float(-s)) for r, (s, b) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    """Clusters, one of them with a third of all rows, copies, opposite vectors and vectors of length 0."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (12, 16))
    which = np.where(rng.random(400) < 0.33, 0, rng.integers(0, 12, 400))
    m = centres[which] + rng.normal(0, 0.25, (400, 16))
    m[50:60], m[60], m[61], m[62] = m[50], -m[50], 0, 0
    return [(int(i) * 3, x.tolist()) for i, x in zip(rng.permutation(400), m)]


@pytest.mark.parametrize("k,least,part", [(400, 0.3, False), (400, 0.8, False), (5, 0.97, True), (7, None, False), (399, None, True)])
def test_all_pairs(spark, monkeypatch, rows, k, least, part):
    monkeypatch.setattr(A, "BLOCK_ROWS", 30)
    monkeypatch.setattr(A, "CELL_ROWS", 25)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = {i for i, _ in rows if not part or i % 10 == 0}
    seen = []
    out = A.neighbours(frame, k, least, frame.where("vec_id % 10 = 0") if part else None, seen.append).collect()
    assert {(r.src, r["rank"]): (r.dst, r.score) for r in out} == plain(rows, asked, k, least)
    assert seen[0]["pivots"] == 16
    if least and least > 0.5:
        assert seen[0]["share_met"] < (0.75 if least == 0.8 else 0.45)


def test_empty_and_missing_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.8, 0.6])], "vec_id long, embedding array<double>")
    assert [(r.src, r.dst, r.score) for r in A.neighbours(frame, 3, 0.5).orderBy("src").collect()] == [(2, 3, 0.8), (3, 2, 0.8)]
    assert A.neighbours(frame.limit(0), 3, 0.5).count() == 0 and A.neighbours(frame.where("vec_id = 2"), 3).count() == 0


def test_vectors_that_all_meet_are_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8))
    vectors[13] = 0.0
    vectors[20:24] = vectors[30]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(size > 0, size, 1.0)
    score = np.round(unit @ unit.T, 6)
    monkeypatch.setattr(A, "MOST_COPIES", 1)
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    monkeypatch.setattr(A, "MET_BYTES", 20_000)
    got = A.neighbours(frame, 9, 0.1)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    found = {}
    for r in got.collect():
        found.setdefault(r.src, []).append((r["rank"], r.dst, pytest.approx(r.score, abs=2e-6)))
    for i in range(len(vectors)):
        best = sorted((-score[i, j], j) for j in range(len(vectors)) if j != i and score[i, j] >= 0.1)[:9]
        assert sorted(found.get(i, []), key=lambda x: x[0]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
