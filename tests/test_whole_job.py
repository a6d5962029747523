"""Queries against plain versions of the whole job: no SQL that shares their cuts."""

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from hopweave.functions import text as X
from hopweave.operators import evaluation as E, graph as G, ranking as R
from hopweave.plans import eval_queries, graph_queries, model_queries
from hopweave.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def pagerank(duck, steps):
    """Scores of all passages by nation after so many steps, in plain numpy."""
    triples = duck.sql(f"WITH {graph_queries.TRIPLES} SELECT chunk, subj, obj FROM triples").fetchall()
    weights = {}
    for _, a, b in triples:
        if a != b:
            weights[a, b] = weights.get((a, b), 0) + 2.0
            weights[b, a] = weights.get((b, a), 0) + 2.0
    for chunk, entity in {(c, e) for c, a, b in triples for e in (a, b)}:
        weights["p " + chunk, entity] = weights[entity, "p " + chunk] = 1.0
    nodes = {n: i for i, n in enumerate(sorted({a for a, _ in weights}))}
    src, dst = (np.array([nodes[e[k]] for e in weights]) for k in (0, 1))
    w = np.array(list(weights.values()))
    p = w / np.bincount(src, w, len(nodes))[src]
    out = {}
    for key, name in duck.sql("SELECT n_nationkey, lower(n_name) FROM nation").fetchall():
        if name in nodes:  # a nation without customers' orders reaches no passage
            r = np.zeros(len(nodes))
            r[nodes[name]] = 1
            x = r
            for _ in range(steps):
                x = 0.5 * np.bincount(dst, x[src] * p, len(nodes)) + 0.5 * r
            out[key] = {n: x[i] for n, i in nodes.items() if n.startswith("p ") and x[i] > 0}
    return out


def test_pagerank_settles(spark, duck):
    want, got = pagerank(duck, 200), {}
    for r in graph_queries.ppr_topk(spark, DIR).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.node, r.score)
    assert set(got) == set(want)
    for key, scores in want.items():
        best = sorted(scores.values(), reverse=True)[:10]
        assert sorted(got[key]) == list(range(1, len(best) + 1))
        for rank, (node, score) in got[key].items():
            assert abs(score - scores[node]) < 1e-6 and abs(score - best[rank - 1]) < 1e-6


def test_pagerank_steps_match_their_sql_and_report_the_last_change(spark, duck):
    changes = []
    rows = graph_queries.nearest_passages(spark, DIR, 4, changes.append).collect()
    plain = sorted((r.query_id, r.rank, r.node, round(r.score, 5)) for r in rows)
    sql = duck.sql(f"SELECT query_id, rank, node, score FROM ({graph_queries._pagerank_sql(4)})").fetchall()
    assert plain == sorted((q, k, n, round(s, 5)) for q, k, n, s in sql)
    graph_queries.nearest_passages(spark, DIR, graph_queries.SETTLED, changes.append)
    assert 1e-3 < changes[0] < 0.5 and changes[1] < 5e-7


def greedy_evidence(rows, slots=5, size=80):
    """rows: (passage, base, goal_score, goal, tokens) of one source; the pool and the selection in plain loops."""
    rows = sorted(rows)
    best = {}
    for r in rows:
        if r[3] not in best or r[2] > best[r[3]][2]:
            best[r[3]] = r
    reserved = {r[0] for r in best.values()}
    pool = sorted(rows, key=lambda r: (r[0] not in reserved, -round(0.4 * r[1] + 0.6 * r[2], 6), r[0]))[:size]
    goals, covered, picked, out = {r[3] for r in pool}, set(), [], []
    for _ in range(slots):
        top = None
        for r in sorted(pool):
            twin = max((len(r[4] & p) / max(1, len(r[4] | p)) for p in picked), default=0.0)
            value = 0.4 * r[1] + 0.25 * r[2] + 0.45 * len({r[3]} - covered) / len(goals) - 0.15 * twin
            if top is None or value > top[0] + 1e-12:
                top = (value, r)
        if top is None:
            break
        pool.remove(top[1])
        covered.add(top[1][3])
        picked.append(top[1][4])
        out.append((top[1][0], pytest.approx(top[0], abs=1e-6)))
    return out


def test_evidence_comes_from_whole_sources(spark):
    dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{dir}/documents.parquet").select("doc_id", "lang", "source", X.tokens(X.surface_norm(F.col("text"))).alias("t")).collect()
    sources, got = {}, {}
    for r in docs:
        sources.setdefault(int(r.source[3:]), []).append((str(r.doc_id), 1.0 / (1 + r.doc_id % 50), r.doc_id % 7 / 7.0, r.lang, set(r.t)))
    for r in model_queries.evidence_prefix(spark, dir).orderBy("step").collect():
        got.setdefault(r.query_id, []).append((r.passage, r.objective))
    assert got == {k: greedy_evidence(v) for k, v in sources.items()} and max(map(len, sources.values())) > 80


def test_evidence_pool_takes_repeated_rows_once(spark, tmp_path):
    rows = [(i, f"word{i} text", "en", "src1", 9) for i in range(300)] + [(299, "word299 text", "en", "src1", 9)] * 100
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    plain = [(str(i), 1.0 / (1 + i % 50), i % 7 / 7.0, "en", {f"word{i}", "text"}) for i in range(300)]
    got = model_queries.evidence_prefix(spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.passage, r.objective) for r in got] == greedy_evidence(plain)


def test_path_pool_counts_passages(spark):
    rows = [(1, "a", [f"n{i}"], 1 - i / 1000) for i in range(100)] + [(1, "b", ["m"], 0.5), (1, "c", ["m"], 0.4)]
    pool = R.path_pool(spark.createDataFrame(rows, "query_id long, passage string, nodes array<string>, total double"), 2).collect()
    assert {r.passage for r in pool} == {"a", "b"} and len(pool) == 101


def synonyms(rows, least, at_most=101):
    """All (src, dst, weight) from plain cosines."""
    ids = [i for i, _ in rows]
    m = np.array([list(v) for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    score, out = np.round(m @ m.T, 6).tolist(), set()
    for i, s in zip(ids, score):
        out |= {(i, j, round(x, 5)) for x, j in sorted((-x, j) for x, j in zip(s, ids) if j != i and x >= least)[:at_most] for x in [-x]}
    return out


def test_every_vector_asks_for_synonyms(spark, duck):
    got = {(r.src, r.dst, round(r.weight, 5)) for r in graph_queries.synonym_edges(spark, DIR).collect()}
    assert got == synonyms(duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall(), 0.3)
    sql = {(a, b, round(w, 5)) for a, b, w in duck.sql(f"SELECT src, dst, weight FROM ({ORACLE_SQL['synonym_edges']})").fetchall()}
    assert got == sql


def test_synonyms_keep_the_nearest_101_at_08(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in [5, 0, 0] + draw.normal(size=3)]) for i in range(150)] + [(200, [0.0, 0.0, -1.0])]
    got = {(r.src, r.dst, round(r.weight, 5)) for r in G.synonym_edges(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == synonyms(rows, 0.8) and max(sum(r[0] == i for r in got) for i, _ in rows) == 101


def test_knn_loses_no_pair_between_partitions(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(300)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = G.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 300)
        assert {r["count"] for r in out.groupBy("src").count().collect()} == {299} and out.count() == 300 * 299
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_bootstrap_takes_2000_repetitions(spark, monkeypatch):
    seen, run = [], E.bootstrap_interval
    monkeypatch.setattr(E, "bootstrap_interval", lambda rows, *more: seen.append(rows) or run(rows, *more))
    assert eval_queries.bootstrap_interval(spark, DIR).first() == run(seen[0], 2000).first()


def test_bootstrap_matches_a_plain_one(spark):
    draw = np.random.default_rng(5)
    rows = [(i % 3, float(i % 3 + draw.normal()), i) for i in range(400)]
    groups = [np.array([d for s, d, _ in rows if s == k]) for k in range(3)]
    means = sorted(sum(draw.choice(g, len(g)).sum() for g in groups) / len(rows) for _ in range(2000))
    low, high = means[int(0.025 * 1999)], means[int(0.975 * 1999)]
    got = E.bootstrap_interval(spark.createDataFrame(rows, "stratum int, d double, row_id long")).first()
    assert got.low == pytest.approx(low, abs=0.1 * (high - low)) and got.high == pytest.approx(high, abs=0.1 * (high - low))
