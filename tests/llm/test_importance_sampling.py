import hashlib
import math
import random
import zlib

import pytest

from hopweave.llm import importance_sampling as m
from hopweave.llm.scratch import Scratch
from tests.llm.brute import plain_words


def runs(text, longest):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=25, least=20, longest=2, buckets=10000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text, longest):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, asked = [], []
    for doc_id, text in docs:
        own = runs(text, longest)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if doc_id is not None and len(plain_words(text)) >= least:
            asked.append(out[-1])
    for rank, row in enumerate(sorted(asked, key=lambda r: (-r[3], r[0]))[: percent * len(asked) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def collect(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest,buckets,slice_bytes", [(2, 10000, 16 << 20), (1, 97, 500), (4, 70000, 500)])
def test_random_texts(spark, monkeypatch, longest, buckets, slice_bytes):
    rng = random.Random(11)
    pool = ["the", "A", "ünï", "42", "日本", "x-y", "Straße", "\x00", "İ", "end."]
    docs = [(i % 190, " ".join(rng.choice(pool) for _ in range(rng.choice((0, 3, 19, 20, 60))))) for i in range(200)]
    docs += [(1000 + i, "same words " * 15) for i in range(100)] + [(7, None), (8, ""), (9, " \n"), (10, "long one " * 20000)]
    docs = [(i, t) for i, t in dict(docs).items()]
    target = ["the the ünï 42", None, "", "same words"]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n_words int, score string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(m, "SLICE_BYTES", slice_bytes)
    got = m.resample(frame, aim, Scratch(spark, "t13"), longest=longest, buckets=buckets)
    assert collect(got) == plain(docs, target, longest=longest, buckets=buckets)


def test_repeated_and_missing_ids_and_empty_tables(spark):
    text = "one two three four five " * 5
    rows = [(1, text), (1, text), (1, text), (None, text), (2, "short"), (3, text)]
    frame, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("one two",)], "text string")
    got = m.resample(frame, aim, Scratch(spark, "t13"), percent=75).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 6
    assert [(r.score, r["rank"]) for r in got if r.doc_id is None] == [(None, None)]
    assert m.resample(frame.limit(0), aim, Scratch(spark, "t13")).count() == 0
    assert collect(m.resample(frame, aim.limit(0), Scratch(spark, "t13"))) == plain(rows, [])
