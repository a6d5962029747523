"""The discriminant against the same formula in NumPy over the same features; rows at the edges."""

import math
import zlib

import numpy as np
import pytest

from hopweave.llm import quality_classifier as q
from hopweave.llm import queries
from hopweave.llm.scratch import Scratch

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_scores_follow_the_formula_and_tell_classes_apart(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    names = list(q.FEATURES)
    x = {r.doc_id: np.array([r[n] for n in names]) for r in q.features(docs).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    train = [d for d in x if d in y and not held(d)]
    data = [np.stack([x[d] for d in train if y[d] == k]) for k in (0, 1)]
    pooled = sum(len(d) * np.cov(d.T, bias=True) for d in data) / len(train)

    def log_density(k, v):
        c = 0.9 * np.cov(data[k].T, bias=True) + 0.1 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-4 * np.eye(len(names))
        gap = v - data[k].mean(axis=0)
        return math.log(len(data[k]) / len(train)) - np.linalg.slogdet(c)[1] / 2 - gap @ np.linalg.solve(c, gap) / 2

    out = {r.doc_id: r for r in queries.op5_quality_classifier(spark, DIR).collect()}
    assert set(out) == set(x)
    for d, r in out.items():
        want = 1 / (1 + math.exp(min(700, log_density(0, x[d]) - log_density(1, x[d]))))
        assert r.score == pytest.approx(want, abs=1e-6)
        assert r.held_out == held(d) and r.predicted == (r.score >= 0.3)
    good, bad = ([out[d].score for d in y if d in out and held(d) and y[d] == k] for k in (1, 0))
    assert good and bad
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # area under the curve on the held-out fifth
    assert np.mean([out[d].predicted == y[d] for d in y if d in out and held(d)]) > 0.9


def classify(spark, docs, labels):
    rows = q.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), Scratch(spark, "t5")).collect()
    return [(r.doc_id, r.score, r.predicted) for r in rows]


def test_without_both_classes_every_score_is_a_half(spark):
    docs = [(1, "some text"), (2, None)]
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, None), (2, 7)], [(None, 0), (None, 1)]):
        assert sorted(classify(spark, docs, labels)) == [(1, 0.5, 1), (2, 0.5, 1)]
    assert classify(spark, [], []) == [] == classify(spark, [], [(1, 0), (2, 1)])


def test_edge_rows(spark):
    rows = [(1, "the text of a page and what it is for " * 9), (2, "### $$$ !!! ||| " * 9), (3, None), (4, ""), (5, "word " * 200_000), (None, "no id"), (6, "same"), (6, "same"), (7, "### $$$ ||| !!! " * 5), (8, "it is for the page " * 20)]
    docs = spark.createDataFrame([(*r, 1.0, "x", 3) for r in rows], "doc_id long, text string, f_symbols double, _t string, n_words int")
    labels = spark.createDataFrame([(1, 1), (8, 1), (2, 0), (7, 0), (1, 1)], "doc_id long, quality int")
    out = q.classify(docs, labels, Scratch(spark, "t5")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[6]) == 1 and by[3] == by[4]


def test_a_row_without_doc_id_is_not_held_out(spark):
    docs = spark.createDataFrame([(None, "some words of a text"), (3, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: (r.held_out, r.score) for r in q.classify(docs, labels, Scratch(spark, "t5")).collect()}
    assert out[None] == (False, 0.5) and out[3][0] in (True, False)
