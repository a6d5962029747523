import random

import numpy as np
import pytest

from hopweave.llm import queries, substring_dedup as s
from hopweave.llm.hashing import word_hashes
from hopweave.llm.scratch import Scratch
from tests.llm import brute


def collect(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equal_windows_share_an_anchor():
    rng = random.Random(4)
    for trial in range(300):
        letters = [b"a", b"b", b"c"][: 1 + trial % 3] if trial % 2 else [str(i).encode() for i in range(500)]
        window = [rng.choice(letters) for _ in range(s.WIDTH)]
        found = []
        for _ in range(2):
            before, after = ([rng.choice(letters) for _ in range(rng.randrange(60))] for _ in range(2))
            words = before + window + after
            starts = s.symbol_starts(word_hashes(words), np.zeros(len(words), np.int64)) - len(before)
            found.append(set(starts[(starts >= 0) & (starts <= s.LOSS)].tolist()))
        assert found[0] & found[1]


def test_documents_match_brute_force(spark):
    dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir}/documents.parquet").collect()]
    want = brute.repeats(docs)
    assert sum(x[1] > 0 for x in want.values()) > 50
    assert collect(queries.op9_substring_dedup(spark, dir)) == want


@pytest.mark.parametrize("chunk", [8_000_000, 3000])
def test_passages_runs_and_edge_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(s, "CHUNK_BYTES", chunk)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    rows = [(1000, None), (1001, ""), (1002, " \n "), (1003, "a " * 300), (1004, "a " * 49), (1005, "b " + "a " * 120 + "b"), (1006, "ab cd " * 200), (1007, "x ab cd " + "ab cd " * 90)]
    for i in range(80):
        parts = []
        for _ in range(3):
            parts += [word() for _ in range(rng.randrange(40))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((rng.randrange(10**6) + 2000, rng.choice(["\n", " ", "\t"]).join(parts)))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    assert collect(s.remove_repeats(frame, Scratch(spark, "t9"))) == brute.repeats(rows)


def test_repeated_rows_null_id_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in s.remove_repeats(frame, Scratch(spark, "t9")).collect()) == [(False, 0), (False, 0), (False, 60), (True, 0)]
    assert s.remove_repeats(frame.limit(0), Scratch(spark, "t9")).count() == 0
