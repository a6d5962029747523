import random

import numpy as np

from hopweave.llm import minhash_dedup as m
from hopweave.llm.scratch import Scratch
from tests.llm import brute

DATA = "/root/testdata/sf0.001/documents.parquet"


def run(spark, rows, schema="doc_id long, text string"):
    out = m.near_duplicates(spark.createDataFrame(rows, schema), Scratch(spark, "t1"))
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(DATA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(docs, Scratch(spark, "t1")).collect()}
    assert out == brute.near_duplicates(rows)


def test_chained_copies_and_edge_cases(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):  # copies with edits of their own: many pairs fall below the threshold, chains remain
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "oNE  two"), (6, "two one"), (7, "a " * 50000), (8, "a a a a a a")]
    assert run(spark, rows) == brute.near_duplicates(rows)


def test_empty_table_null_id_and_extra_columns(spark):
    assert run(spark, []) == {}
    out = m.near_duplicates(
        spark.createDataFrame([(None, "a b c", 1, 2), (5, "a b c", 1, 2), (5, "a b c", 1, 2)], "doc_id long, text string, n long, rep int"), Scratch(spark, "t1")
    ).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in out) == [(False, 5, True), (False, 5, True), (True, None, True)]


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.6, 0.85, 0.95):
        for _ in range(40):
            n = 1000
            both = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) for _ in range(2))
            e = m.estimate(m.registers(m.mix(a))[None], m.registers(m.mix(b))[None], np.array([1000.0]), np.array([1000.0]))[0]
            errors.append(e - len(both) / (2 * n - len(both)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_IDS", 0)
    monkeypatch.setattr(m, "CELL_ITEMS", 1)  # sixteen sets on either side
    test_chained_copies_and_edge_cases(spark)


def test_loose_copies_without_a_centre(spark):
    """Copies of a text that is not there: hardly any pair is linked, but all of them meet."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice((2, 3, 3, 4, 9))):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[: 120 - rng.randrange(3)])))
    assert run(spark, rows) == brute.near_duplicates(rows)


def test_shared_counts_are_exact():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.zipf(1.3, rng.integers(1, 300)) % 5000).astype(np.uint64) for _ in range(n)] for n in (150, 40))
    got = m.shared_counts(left, right)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(left) for j, b in enumerate(right))


def test_texts_are_split_in_slices(spark, monkeypatch):
    texts = [b"a" * 5, b"", b"b" * 20, b"c", b"d"]
    monkeypatch.setattr(m, "SLICE_BYTES", 8)
    assert list(m.slices(texts)) == [(0, 2), (2, 3), (3, 5)] and list(m.slices([])) == []


def test_one_doc_id_with_texts_of_several_classes_links_them(spark):
    w, v, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "wvu")
    near = w + " w30"
    rows = [(1, w), (2, v), (2, w), (3, v), (4, u), (4, "short text"), (5, near), (9, "short text"), (6, None), (6, u)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(frame, Scratch(spark, "t1")).collect())
    assert out == [(1, 26, 1, True), (2, 26, 1, False), (2, 26, 1, False), (3, 26, 1, False), (4, 1, 4, True), (4, 26, 4, True), (5, 27, 1, False), (6, 0, 6, True), (6, 26, 4, False), (9, 1, 4, False)]
