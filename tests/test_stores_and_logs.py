"""Commits of several tables, logs by byte range, the exact bootstrap and path hints."""

import hashlib
import random

import numpy as np
import pytest

from hopweave.operators import evaluation as E, hints as H
from hopweave.sources import logs, stores
from hopweave.sources.shared import keep


def test_two_writers_and_a_reader_in_between(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    v = lambda *names: spark.createDataFrame([(n, "entity") for n in names], "name string, kind string")
    e = lambda *pairs: spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    assert stores.save_graph(root, v("a", "b"), e("ab"), False) == 1
    base = stores.Commits(spark, root).version()
    vertices, edges = stores.load_graph(spark, root)  # the reader, before the second commit
    assert stores.save_graph(root, v("a", "b", "c"), e("ab", "bc"), False, base) == 2
    with pytest.raises(stores.Conflict):
        stores.save_graph(root, v("z"), e("zz"), False, base)
    assert vertices.count() == 2 and edges.count() == 1
    assert {r.name for r in stores.load_graph(spark, root)[0].collect()} == {"a", "b", "c"} and stores.load_graph(spark, root)[1].count() == 2
    assert stores.load_graph(spark, root, 1)[1].count() == 1
    log = stores.Commits(spark, root)
    log.commit({"vertices": v("q")})  # edges stay as they were
    assert log.version() == 3 and [r.name for r in log.read("vertices").collect()] == ["q"] and log.read("edges").count() == 2


def test_a_lost_writer_and_upserts_that_meet(spark, tmp_path, monkeypatch):
    t = stores.Versioned(spark, f"file://{tmp_path}/t", "key string, response string")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, response string")
    t.upsert(rows(("a", "2"), ("a", "1"), ("b", "1")), ["key"])
    commit, met = t.log.commit, []

    def slow(tables, base=None):
        if not met:  # another writer is first
            met.append(1)
            stores.Versioned(spark, t.root, t.schema).upsert(rows(("c", "3")), ["key"])
        return commit(tables, base)

    monkeypatch.setattr(t.log, "commit", slow)
    assert sorted(map(tuple, t.upsert(rows(("b", "9")), ["key"]).collect())) == [("a", "1"), ("b", "9"), ("c", "3")]
    monkeypatch.undo()
    t.log._fs.create(t.log._path(f"{t.root}/_claims/{t.log.version() + 1}"), False).close()  # a writer that was lost
    monkeypatch.setattr(stores.time, "sleep", lambda s: None)
    with pytest.raises(stores.Conflict):
        t.replace(rows(("x", "x")))
    monkeypatch.setattr(stores, "STALE_SECONDS", -1)
    assert t.replace(rows(("x", "x"))).collect() == [("x", "x")]


@pytest.mark.parametrize("tail", [b"", b"\n"])
def test_ranges_that_cut_lines_count_each_line_once(spark, tmp_path, monkeypatch, tail):
    rng = random.Random(1)
    lines = [f'{i} "POST /v1/chat/completions HTTP/1.1" {rng.choice((200, 200, 503))} ' + "é" * rng.randrange(20) for i in range(60)] + ["", "last"]
    data = "\n".join(lines).encode() + tail
    path = tmp_path / "server.log"
    path.write_bytes(data)
    monkeypatch.setattr(logs, "PIECE", 37)
    for cuts in ([0, len(data)], [0, 1, 50, 51, 900, len(data) - 2, len(data)], sorted({0, len(data), *rng.sample(range(len(data)), 12)})):
        got = [x for a, b in zip(cuts, cuts[1:]) for x in logs.lines_of(lambda at, n: data[at : at + n], len(data), a, b)]
        assert [x.decode() for _, x in got] == lines and all(data[o : o + len(x)] == x for o, x in got)
    out = logs.log_lines(spark, f"file://{path}", segment=101).orderBy("offset").collect()
    assert [r.value for r in out] == lines
    middle = len(data) // 2
    parts = [logs.log_lines(spark, str(path), a, b, 64).count() for a, b in ((0, middle), (middle, len(data)))]
    assert sum(parts) == len(lines) and logs.log_lines(spark, str(path), 5, 5).count() == 0
    hashes = logs.segment_hashes(spark, str(path), 10, 500, 200).orderBy("begin").collect()
    assert [(r.begin, r.end, r.sha256) for r in hashes] == [(a, b, hashlib.sha256(data[a:b]).hexdigest()) for a, b in ((10, 210), (210, 410), (410, 500))]
    client = spark.createDataFrame([("one", "200", 1), ("two", "503", sum(" 503 " in x for x in lines))], "stage string, code string, n int")
    audit = {(r.stage, r.code): (r.server, r.client, r.agrees) for r in logs.archive_audit(spark, str(path), [("one", 0, middle), ("two", 0, len(data))], client).collect()}
    assert audit["two", "503"][2] and audit["two", "200"] == (sum(" 200 " in x for x in lines), 0, False) and audit["one", "200"][1] == 1


def test_draws_of_all_leaves_add_up(spark, monkeypatch):
    sizes = [5, 0, 7, 1, 40, 3]
    m = np.array([E._draws(sizes, leaf, [1, 2], 300) for leaf in range(6)])
    assert (m.sum(axis=0) == 56).all() and (m[1] == 0).all()
    assert abs(m.mean(axis=1) - np.array(sizes)).max() < 1.5
    monkeypatch.setattr(E, "LEAF_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [(i % 3, float(i % 3 + rng.normal()), i) for i in range(400)] + [(1, None, 999)]
    frame = spark.createDataFrame(rows, "stratum int, d double, row_id long")
    got = E.bootstrap_interval(frame.repartition(3), 800).first()
    assert got == E.bootstrap_interval(frame.coalesce(1), 800).first()
    groups = [np.array([d for s, d, _ in rows if s == k and d is not None]) for k in range(3)]
    means = sorted(sum(rng.choice(g, len(g)).sum() for g in groups) / 400 for _ in range(2000))
    low, high = means[49], means[1949]
    assert got.low == pytest.approx(low, abs=0.15 * (high - low)) and got.high == pytest.approx(high, abs=0.15 * (high - low))
    one = E.bootstrap_interval(spark.createDataFrame([(1, 2.0, 1), (2, 4.0, 2)], "stratum int, d double, row_id long"), 50).first()
    assert (one.low, one.high) == (3.0, 3.0)  # a stratum of one row is drawn as it is
    assert E.bootstrap_interval(frame.limit(0), 50).first().low is None


def test_hints_in_three_tiers(spark):
    ranked = spark.createDataFrame([(q, f"d{q}{i}", i, 1.0 - i / 10) for q in (1, 2, 3, 4) for i in (1, 2, 3)], "query_id long, passage string, rank int, score double")
    seeds = spark.createDataFrame([(1, "s", 0.6), (1, "t", 0.4), (2, "s", 1.0), (3, "z", 1.0), (3, "y", 0.5)], "query_id long, seed string, prob double")
    bridges = spark.createDataFrame([(1, "s", "b"), (1, "s", "c"), (1, "t", "b"), (1, "t", "nowhere"), (2, "s", "gone")], "query_id long, seed string, bridge string")
    holds = spark.createDataFrame([("d11", "b"), ("d12", "b"), ("d12", "c"), ("d13", "c"), ("d21", "s"), ("d21", "x"), ("d21", "w"), ("d22", "x"), ("d31", "u"), ("d31", "v"), ("d41", "b")], "passage string, entity string")
    idf = spark.createDataFrame([("b", 1.5), ("c", 2.0), ("x", 1.0), ("w", 3.0), ("u", 2.0), ("v", 2.0), ("s", 1.0)], "entity string, idf double")
    texts = spark.createDataFrame([("d11", "b here"), ("d12", "b and c"), ("d13", "c"), ("d21", "x only"), ("d22", "x"), ("d31", "nothing")], "passage string, text string")
    found = keep(H.candidates(ranked, seeds, bridges, holds, idf, texts, keep, pool=1))
    rows = {(r.query_id, r.seed, r.bridge, r.passage, r.tier) for r in found.collect()}
    # d13 has the least score, so c stands only in d12; of query 2 the rarest other entity, w, is not in the text.
    assert rows == {(1, "s", "b", "d11", 1), (1, "s", "b", "d12", 1), (1, "s", "c", "d12", 1), (1, "t", "b", "d11", 1), (1, "t", "b", "d12", 1), (2, "s", "w", "d21", 3), (3, "y", "u", "d31", 3)}
    wide = {(r.query_id, r.bridge, r.tier) for r in H.candidates(ranked, seeds, bridges, holds, idf, texts, keep).collect() if r.query_id == 2}
    assert wide == {(2, "x", 2)}
    out = sorted((r.query_id, r.hint_id, r.seed, r.bridge, r.votes, r.confidence, r.conflict) for r in H.hints(found, idf).collect())
    assert out == [(1, 0, "s", "b", 2, 0.88, 0.5), (1, 1, "t", "b", 2, 0.82, 0.5), (2, 0, "s", "w", 1, 1.0, 0.0), (3, 0, "y", "u", 1, 0.85, 0.0)]
    assert H.hints(found, idf, per_seed=2, most=1).count() == 3
