import hashlib

import numpy as np
import pytest

from hopweave.llm import decontaminate as d, queries
from hopweave.llm.fm_index import FMIndex
from hopweave.llm.scratch import Scratch
from tests.llm import brute


def collect(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    seq = np.concatenate([rng.integers(1, 5, 400), np.full(50, 3), rng.integers(1, 5, 50)])
    index = FMIndex(seq, 6)
    patterns = [rng.integers(1, 6, n) for n in (1, 2, 3, 4, 4, 5)] + [np.full(9, 3), seq[-4:]]
    low, high = index.ranges(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(seq) - len(p) + 1) if np.array_equal(seq[i : i + len(p)], p)]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_documents_match_brute_force(spark):
    dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{dir}/benchmark.parquet").collect()]
    want = brute.contamination(docs, items)
    assert any(x[4] for x in want.values())
    assert collect(queries.op10_decontamination(spark, dir)) == want


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_edge_rows_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    docs = [(1, None), (2, ""), (3, "x Short ITEM y short item"), (4, "a b c d e f g h i j k l" * 300), (5, "a-b c,d e f g h i j k l"), (6, "--"), (7, "ünï cødé 1 2"), (8, "a " * 30000)]
    items = [(1, "short item"), (2, "A b c d e f g h i j k l"), (3, None), (4, ""), (10, "short item"), (9, "ÜNÏ cødé"), (11, "ünï cødé"), (12, "a a a a a a a a a a a")]
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collect(d.report(d.find_spans(frame, bench, Scratch(spark, "t10")))) == brute.contamination(docs, items)
    assert d.find_spans(frame.limit(0), bench, Scratch(spark, "t10")).count() == 0
    assert not any(r.contaminated for r in d.report(d.find_spans(frame, bench.limit(0), Scratch(spark, "t10"))).collect())


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_items_without_an_id_are_hit(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    frame = spark.createDataFrame([(1, "one two three"), (2, "x one two three four y"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "three four"), (None, "four")], "item_id long, text string")
    out = collect(d.report(d.find_spans(frame, bench, Scratch(spark, "t10"))))
    seven = hashlib.sha256(b"7").hexdigest()
    assert out == {1: (3, 3, 1, hashlib.sha256(b"").hexdigest(), True), 2: (6, 4, 2, seven, True), 3: (1, 0, 0, hashlib.sha256(b"").hexdigest(), False)}
