"""Retrieval rounds, extraction by models, stores, evidence selection and trials on small fixtures."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.functions import repair
from hopweave.operators import extraction as E, graph as G, providers as P, retrieval as S, selection as L, trials as T
from hopweave.sources import stores
from hopweave.sources.shared import keep

TRIPLES = [("c1", "alice", "born in", "paris"), ("c2", "alice", "wrote", "book"), ("c3", "bob", "born in", "rome"), ("c4", "book", "about", "rome")]


@pytest.fixture(scope="module")
def index(spark):
    t = spark.createDataFrame(TRIPLES, "chunk string, subj string, pred string, obj string")
    vector = {"alice": [1.0, 0.0, 0.0], "book": [0.8, 0.6, 0.0], "paris": [0.6, 0.0, 0.8], "bob": [0.0, 1.0, 0.0], "rome": [0.0, 0.8, 0.6]}
    entities = spark.createDataFrame(list(vector.items()), "entity string, embedding array<double>")
    passages = spark.createDataFrame([(c, (np.array(vector[s]) / 2 + np.array(vector[o]) / 2).tolist()) for c, s, _, o in TRIPLES], "chunk string, embedding array<double>")
    facts = spark.createDataFrame([(i, s, o, (np.array(vector[s]) / 2 + np.array(vector[o]) / 2).tolist()) for i, (_, s, _, o) in enumerate(TRIPLES)], "fact long, subj string, obj string, embedding array<double>")
    return S.index_of(t, facts, entities, passages, keep)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 3)], "query_id long, embedding array<double>, hops int")


def test_dense_scores_in_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    q, v = rng.integers(-2, 3, (7, 4)).astype(float), rng.integers(-2, 3, (50, 4)).astype(float)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(G, "BLOCK_BYTES", 64)
    for top in (None, 5):
        got = {}
        for r in G.dense_scores(queries, rows, top).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.raw, round(r.score, 9))
        for i, x in enumerate(q):
            s = v @ x
            order = sorted(range(50), key=lambda j: (-s[j], j))[:top]
            assert got[i] == {k + 1: (j, s[j], round((s[j] - s.min()) / (s.max() - s.min()), 9)) for k, j in enumerate(order)}
    assert G.dense_scores(queries.limit(0), rows, 5).count() == 0 == G.dense_scores(queries, rows.limit(0), 5).count()


def test_searches_start_where_the_question_points(index, asked):
    for search in (S.graph_search, S.path_search, S.fallback_search):
        first = {r.query_id: r.passage for r in search(asked, index, top=4).collect() if r.rank == 1}
        assert first[1] in {"c1", "c2"} and first[2] in {"c3", "c4"}, search.__name__


def test_ladder_takes_the_fallback_without_facts(index, asked):
    out = S.retrieve(asked, index, lambda facts: facts.where("query_id = 1")).collect()
    assert {(r.query_id, r.route) for r in out} == {(1, "path"), (2, "fallback")}
    assert S.retrieve(asked.limit(0), index).count() == 0


def test_second_round_and_tracks(spark, index, asked):
    ranked = S.graph_search(asked, index, top=4)
    known = spark.createDataFrame([(1, "alice"), (2, "bob")], "query_id long, entity string")
    fused = S.second_round(ranked, asked, index, known)
    for q in (1, 2):
        rows = sorted((r for r in fused.collect() if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4] and 0 <= rows[-1].score <= rows[0].score <= 1
    subs = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (1, "b", [0.0, 0.8, 0.6])], "query_id long, sub_question string, embedding array<double>")
    track = {r.passage: r.score for r in S.decomposed_track(subs, index, docs=1).collect()}
    assert set(track) == {"c1", "c2", "c3", "c4"} and all(v > 0 for v in track.values())


def test_anchors_bind_the_next_question(spark):
    rows = spark.createDataFrame([(1, 0, "Who wrote it?"), (1, 1, "Where was $ born?"), (1, 2, "When was $ founded?"), (2, 0, "Where is $?")], "query_id long, ordinal int, question string")
    known = {"Who wrote it?": "Ann", "Where was Ann born?": "Rome"}
    answers = spark.createDataFrame(list(known.items()), "question string, anchor string")
    out = S.bind_anchors(rows, lambda now: now.join(answers, "question"), lambda q, a: F.replace(q, F.lit("$"), a)).collect()
    assert {(r.query_id, r.ordinal, r.question, r.anchor) for r in out} == {(1, 0, "Who wrote it?", "Ann"), (1, 1, "Where was Ann born?", "Rome"), (1, 2, "When was Rome founded?", None), (2, 0, "Where is $?", None)}


def test_entities_by_growing_budgets(spark):
    small = lambda prompts: ['{"entities": ["Ann ", "Rome", "Ann", ""]}' if "short" in p else '{"entities": [' if "long" in p else "none" for p in prompts]
    large = lambda prompts: ['{"entities": []}' if "long" in p else "no" for p in prompts]
    p = spark.createDataFrame([("a", "short"), ("b", "long"), ("c", "broken")], "idx string, passage string")
    out = {r.idx: (r.entities, r.status, r.attempt) for r in E.recognise(p, [small, large], keep).collect()}
    assert out == {"a": (["Ann", "Rome"], "success", 0), "b": ([], "empty_valid", 1), "c": ([], "failed", 2)}


def test_pieces_are_cut_until_they_answer(spark):
    def provider(prompts):
        return [json.dumps({"triples": [["A", "is", w] for w in p.split() if w.startswith("w7")]}) if len(p) <= 200 and "bad" not in p else "too long" for p in prompts]

    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([("x", text), ("y", text + " bad"), ("z", ""), ("n", None)], "idx string, passage string")
    for spans in (repair.windows, repair.source_units):
        out = {r.idx: r for r in E.extract_by_pieces(rows, provider, keep, spans).collect()}
        assert out["x"].status == "success" and {t[2] for t in out["x"].triples} >= {f"w7{i}" for i in range(10)}
        assert out["y"].status == "partial" and out["y"].failed == 1 and out["z"].status == "empty_valid" == out["n"].status


def test_audits(spark):
    rel = spark.createDataFrame([("a", 0, "Ann and Bob wrote it.\nAnn and Bob met.", "Ann and Bob"), ("a", 1, "Title\nAnn met Cy.", "Ann"), ("a", 2, "x", "Ann")], "idx string, ordinal int, passage string, subj string")
    verdicts = spark.createDataFrame([("a", 0, "entailed", "Ann and Bob met"), ("a", 1, "contradicted", "Ann met Cy")], "idx string, ordinal int, verdict string, quote string")
    audited = E.audit_relations(rel, verdicts)
    assert {(r.ordinal, r.accepted, r.reason) for r in audited.collect()} == {(0, True, "supported"), (1, False, "contradicted"), (2, False, "no_verdict")}
    assert E.audit_counts(audited).collect() == [("a", 3, 1, 2, 1)]


def test_fact_filter_realigns(spark):
    facts = spark.createDataFrame([(1, 10, "(alice, born in, paris)", 1), (1, 11, "(alice, wrote, book)", 2), (2, 12, "(bob, is, man)", 1)], "query_id long, fact long, text string, rank int")
    questions = spark.createDataFrame([(1, "Q1"), (2, "Q2")], "query_id long, question string")
    out = E.filter_facts(facts, questions, lambda prompts: ['{"facts": ["[alice, wrote, a book]", "(alice,wrote,book)"]}' if "Q1" in p else "nothing" for p in prompts]).collect()
    assert {(r.query_id, r.fact, r.position) for r in out} == {(1, 11, 0), (2, 12, 0)}


def test_decomposition_and_plans(spark):
    q = spark.createDataFrame([(1, "Who is older?", "h"), (2, "Where?", None)], "query_id long, question string, hints string")
    out = E.decompose(q, lambda prompts: ["1. Who is older?\n- When was A born?\n- When was B born?" if "older" in p else "" for p in prompts], hints="hints").collect()
    assert sorted((r.query_id, r.ordinal, r.sub_question) for r in out) == [(1, 0, "When was A born?"), (1, 1, "When was B born?"), (2, 0, "Where?")]
    node = lambda i, text, deps: {"id": i, "question": text, "depends_on": deps}
    good = json.dumps({"nodes": [node("s1", "Who?", []), node("s2", "Where was ${s1.answer}?", ["s1"])]})
    loop = json.dumps({"nodes": [node("s1", "Who is ${s2.answer}?", ["s2"]), node("s2", "Where was ${s1.answer}?", ["s1"])]})
    plans = spark.createDataFrame([(1, "fine"), (2, "mended"), (3, "never"), (4, "mute")], "plan_id long, question string")
    planned = E.plan_questions(plans, lambda prompts: [good if "fine" in p or "Fault: cycle" in p and "mended" in p else "" if "mute" in p else loop for p in prompts], keep).collect()
    assert sorted({r.plan_id for r in planned}) == [1, 2] and len(planned) == 4


def test_answers(spark):
    rows = ['{"answer": " Rome "}', "I think.\nAnswer: a\nso final answer: Paris \nend", "one\n two \n\n", "", '{"other": 1}\nlast', None]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    assert [r.a for r in df.select(E.answer_of(F.col("r")).alias("a")).collect()] == ["Rome", "Paris", "two", "", "last", ""]
    q = spark.createDataFrame([(1, "Q?"), (2, "R?")], "query_id long, question string")
    ranked = spark.createDataFrame([(1, f"p{i}", i) for i in range(1, 8)], "query_id long, passage string, rank int")
    texts = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(1, 8)], "passage string, text string")
    out = {r.query_id: r.answer for r in E.answer_questions(q, ranked, texts, lambda ps: [f"Answer: {p.count('text')}" for p in ps]).collect()}
    assert out == {1: "5", 2: "0"}


def test_small_text_functions(spark):
    df = spark.createDataFrame([("caf\\u00e9 \\n \"x\"",), ("plain \\n",), ("\\u0041\\u00zz",)], "t string")
    assert [r.d for r in df.select(E.decode_escapes(F.col("t")).alias("d")).collect()] == ['café \\n "x"', "plain \\n", "A\\u00zz"]
    assert spark.createDataFrame([("\\ud83d\\ude00!",)], "t string").select(E.decode_escapes(F.col("t"))).first()[0] == "\U0001f600!"
    v = spark.createDataFrame([('"s"',), ('["a", "b"]',), (None,), ('{"k": 1}',)], "j string").select(E.as_text(F.try_parse_json("j")).alias("x"))
    assert [r.x for r in v.collect()] == ["s", "a\nb", "", '{"k":1}']
    rows = [("List all of them", True), ("Is it red?", True), ("Who wrote it?", False), ("Why did he go?", True)]
    d = spark.createDataFrame(rows, "q string, want boolean")
    assert all(r.n == r.want for r in d.select(E.non_atomic(F.col("q")).alias("n"), "want").collect())
    h = spark.createDataFrame([("was", "Member of Parliament", ["parliament"], True), ("saw", "member of parliament", ["parliament"], False), ("is", "member of nothing", ["parliament"], False)], "p string, o string, k array<string>, want boolean")
    assert all(r.x == r.want for r in h.select(E.hidden_entity(F.col("p"), F.col("o"), F.col("k")).alias("x"), "want").collect())
    c = spark.createDataFrame([("stop", None, [], True, "1", True), ("stop", None, [], False, "1", False), ("length", None, ["a"], False, "1", False), ("stop", None, ["a"], False, "0", False)], "f string, e string, i array<string>, p boolean, v string, want boolean")
    assert all(r.x == r.want for r in c.select(E.completed(*[F.col(x) for x in "feipv"], "1").alias("x"), "want").collect())
    t = spark.createDataFrame([([["a", "b", "c"], ["a", "b", "c"], ["a", "b"], ["", "x", None]],)], "t array<array<string>>")
    assert t.select(E.lenient_triples(F.col("t")).alias("x")).first().x == [["a", "b", "c"], ["", "x", None]]
    assert t.select(E.merged_triples(F.col("t"), F.lit(None).cast("array<array<string>>"), F.col("t")).alias("x")).first().x == [["a", "b", "c"]]


def test_patience_and_windows(spark):
    calls = []

    class Busy(Exception):
        retry_after = 0

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise Busy
        return prompts

    assert E.patient(flaky)(["a"]) == ["a"] and len(calls) == 3
    with pytest.raises(ValueError):
        E.patient(lambda p: (_ for _ in ()).throw(ValueError("no")), attempts=2, wait=0)(["a"])
    w = E.query_windows(spark.range(20).withColumnRenamed("id", "query_id"), "query_id")
    assert [r["count"] for r in w.groupBy("window").count().orderBy("window").collect()] == [8, 8, 4]
    assert E.limited(spark.range(100), 3).rdd.getNumPartitions() == 3


def test_versioned_tables_and_checkpoints(spark, tmp_path):
    t = stores.Versioned(spark, f"file://{tmp_path}/t", "key string, response string")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, response string"), ["key"])
    t.upsert(spark.createDataFrame([("b", "2"), ("c", "2")], "key string, response string"), ["key"])
    assert {tuple(r) for r in t.read().collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    box = stores.open_checkpoint(spark, f"file://{tmp_path}/c", {"model": "m", "prompt": "1"})
    box.upsert(spark.createDataFrame([("i", "p", ["e one", "two"], [["a", "b", "c"]], "success", "k")], stores.EXTRACTIONS), ["idx"])
    again = stores.open_checkpoint(spark, f"file://{tmp_path}/c", {"prompt": "1", "model": "m"})
    assert stores.extraction_stats(again.read()).collect() == [(1, 4.0, 1.5)]
    with pytest.raises(ValueError, match="belongs to"):
        stores.open_checkpoint(spark, f"file://{tmp_path}/c", {"model": "other", "prompt": "1"})


def test_caches_ask_once(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    store = stores.Versioned(spark, f"file://{tmp_path}/r", "key string, response string")
    store.upsert(spark.createDataFrame([("old-b", "kept")], "key string, response string"), ["key"])
    ask = lambda ps: [p.upper() for p in ps]
    run = lambda d, p: sorted(tuple(r) for r in stores.cached_responses(d, store, p, F.lit("m"), F.concat(F.lit("old-"), "prompt")).collect())
    assert run(df, ask) == [("a", "A", False), ("a", "A", False), ("b", "kept", True)]
    assert run(df, lambda ps: ["again"] * len(ps)) == [("a", "A", True), ("a", "A", True), ("b", "kept", True)]
    vectors = stores.Versioned(spark, f"file://{tmp_path}/v", "key string, embedding array<float>")
    texts = spark.createDataFrame([("x y",), ("z",), ("x y",)], "text string")
    one = stores.cached_embeddings(texts, vectors, P.hash_embedding, "passage", 64).collect()
    assert len(one) == 3 and vectors.read().count() == 2
    stores.cached_embeddings(texts, vectors, lambda t: P.hash_embedding(t) * 0, "query", 64).count()
    assert vectors.read().count() == 4


def test_graphs_and_manifests(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    assert [x.count() for x in stores.load_graph(spark, root)] == [0, 0]
    v, e = spark.createDataFrame([("a", "entity")], "name string, kind string"), spark.createDataFrame([("a", "b", 1)], "src string, dst string, weight int")
    stores.save_graph(root, v, e, False)
    vertices, edges = stores.load_graph(spark, root)
    assert vertices.collect() == [("a", "entity")] and edges.collect() == [("a", "b", 1.0, False)]
    stores.write_manifest(spark, root, "ascii-1", "c1", {"edges": edges})
    assert stores.check_manifest(spark, root, "c1", {"edges": edges}) == "ascii-1"
    for contract, df in (("c2", edges), ("c1", edges.limit(0))):
        with pytest.raises(ValueError):
            stores.check_manifest(spark, root, contract, {"edges": df})
    with pytest.raises(ValueError, match="unknown normalisation"):
        stores.write_manifest(spark, f"{root}/x", "other", "c", {})
    rows = spark.createDataFrame([("a", "p", [], [], "failed", "k")], stores.EXTRACTIONS)
    with pytest.raises(ValueError, match="rebuild"):
        stores.guard_stale(e, rows)
    stores.guard_stale(e, rows.withColumn("status", F.lit("success")))


def test_ablation_inputs_and_reports(spark, tmp_path):
    known = spark.createDataFrame([("one",)], "passage string")
    good = {"question": "q", "sample_id": "s", "query_index": 0, "pool": [{"doc_hash": "f97c5d29941bfb1b2fdab0874906ab82", "score": 0.5}], "evidence_call_budget": 3}
    (tmp_path / "a.json").write_text(json.dumps([good]))
    (tmp_path / "b.json").write_text(json.dumps([good | {"pool": [{"doc_hash": "0", "score": 1.0}]}]))
    (tmp_path / "c.json").write_text(json.dumps([good | {"query_index": "x"}]))
    assert [tuple(r) for r in stores.ablation_inputs(spark, f"file://{tmp_path}/a.json", known).collect()] == [(0, 0, "one", 0.5, 3)]
    for name in ("b", "c"):
        with pytest.raises(Exception):
            stores.ablation_inputs(spark, f"file://{tmp_path}/{name}.json", known).collect()
    stores.write_report(spark.createDataFrame([(1, "x")], "n int, s string"), f"file://{tmp_path}/out")
    assert stores.read_report(spark, f"file://{tmp_path}/out", "n int, s string").collect() == [(1, "x")]


POOL = {n: {"base": b, "goals": g, "tokens": set(t.split())} for n, b, g, t in [
    ("a", 0.9, {"x": 0.5}, "one two"), ("b", 0.8, {"x": 0.9}, "one two"), ("c", 0.7, {}, "three"), ("d", 0.2, {"y": 0.9}, "four"), ("e", 0.1, {"z": 0.9}, "five six"), ("f", 0.6, {}, "seven"),
]}


def test_prefixes():
    goals = {"x", "y", "z"}
    best = max(itertools.permutations(POOL, 3), key=lambda s: round(L.utility([POOL[n] for n in s], goals), 9))
    got = L.joint_prefix(POOL, {}, 3)
    assert L.utility([POOL[n] for n in got], goals) >= 0.98 * L.utility([POOL[n] for n in best], goals)
    proven = L.bundles([{"goal": "y", "passage": "d", "quality": 0.9, "accepted": True}, {"goal": "z", "passage": "e", "quality": 0.8, "accepted": True}, {"goal": "w", "passage": "f", "quality": 0.9, "accepted": False}], {"z": ["y"], "v": ["w"]})
    assert proven == {"y": ("d",), "z": ("e", "d")}
    assert {"d", "e"} <= set(L.joint_prefix(POOL, proven, 3))
    order = ["a", "b", "c", "f", "d", "e"]
    out = L.continuous_prefix(order, POOL | {"c": POOL["c"] | {"base": 0.3}}, proven, 3)
    assert L.continuous_prefix(order, POOL, proven, 3) == order  # 13 % more is too little
    assert sorted(out) == sorted(order) and "d" in out[:3] and [n for n in out[3:] if n in "cf"] == sorted(n for n in out[3:] if n in "cf")
    assert L.continuous_prefix(order, {n: p | {"goals": {}, "tokens": {n}} for n, p in POOL.items()}, {}, 3) == order
    proofs = [{"goal": "y", "passage": "e", "quality": 0.6, "accepted": True}, {"goal": "z", "passage": "d", "quality": 0.9, "accepted": True}]
    assert L.dependency_prefix(order, proofs, {"z": ["y"]}, 3) == ["e", "d", "a", "b", "c", "f"]
    assert L.dependency_prefix(order, [], {}, 3) == order


def test_moves_inside_an_order():
    order = list("abcdefghij")
    assert L.ancestor_support(list("abcde"), list("fghij"), {"z": ("a", "h", "i", "j")}, {p: {p} for p in order}) == list("abcdehifgj")
    twins = {p: {p} for p in order} | {"b": {"x"}, "d": {"x"}}
    assert L.ancestor_support(list("abcde"), list("fghij"), {"z": ("a", "h")}, twins) == list("abchedfgij")
    assert L.terminal_evidence(order, ["a", "g"], True) == list("abcdgefhij")
    assert L.terminal_evidence(order, ["a", "g"], True, mode="tail") == list("abcdegfhij")
    assert L.terminal_evidence(order, ["a", "g"], False) == order == L.terminal_evidence(order, ["a", "b"], True)
    assert L.condition_package(order, [("a", "f"), ("b", "g", "h")]) == list("abcdf") + list("eghij")
    assert L.one_swap(order, "h", {"e"}) == list("abchedfgij") and L.one_swap(order, None, set()) == order and L.one_swap(order, "h", set("abcde")) == order


def test_companions(spark):
    ranked = spark.createDataFrame([(q, f"p{i}", i, f"Title {i}") for q in (1, 2) for i in range(1, 9)], "query_id long, passage string, rank int, title string")
    mentions = spark.createDataFrame([(1, "title 7 "), (1, "TITLE 5"), (2, "none")], "query_id long, term string")
    out = {}
    for r in L.anchor_companion(ranked, mentions).collect():
        out.setdefault(r.query_id, {})[r.rank] = r.passage
    assert [out[1][k] for k in range(1, 9)] == ["p1", "p2", "p3", "p7", "p5", "p4", "p6", "p8"] and out[2][5] == "p5"
    tokens = spark.createDataFrame([(f"p{i}", ["x"] if i == 2 else ["x", "y", "z"] if i == 7 else ["w"]) for i in range(1, 9)], "passage string, tokens array<string>")
    conditions = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["x"])], "query_id long, terms array<string>")
    out = {}
    for r in L.condition_companion(ranked, tokens, conditions).collect():
        out.setdefault(r.query_id, {})[r.rank] = r.passage
    assert out[1][5] == "p7" and out[1][6] == "p5" and out[2][5] == "p5"


def test_plan_search_keeps_agreeing_beams(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    plan = spark.createDataFrame([(1, "s1", 0), (1, "s2", 1)], "query_id long, goal string, depth int")
    rows = [(1, "s1", {}, "Ann", "p1", 0.9), (1, "s1", {}, "Bob", "p2", 0.8), (1, "s2", {"s1": "Bob"}, "Rome", "p3", 0.9), (1, "s2", {"s1": "Cy"}, "Oslo", "p4", 1.0)]
    hypotheses = spark.createDataFrame(rows, "query_id long, goal string, given map<string,string>, answer string, passage string, quality double")
    beams = {(r.query_id, tuple(sorted(r.bound.items())), tuple(r.proofs), r.score) for r in L.search_plans(queries, plan, hypotheses, keep).collect()}
    assert beams == {(1, (("s1", "Ann"),), ("p1",), round(0.45 * 0.9 + 0.35 * 0.9 + 0.1, 6)), (1, (("s1", "Bob"), ("s2", "Rome")), ("p2", "p3"), round(0.45 * 0.8 + 0.35 * 0.85 + 0.2, 6)), (2, (), (), 0.0)}


def test_accepted_swaps_change_places(spark):
    ranked = spark.createDataFrame([(1, p, i) for i, p in enumerate("abcdefg", 1)], "query_id long, passage string, rank int")
    accepted = spark.createDataFrame([(1, "b", "f"), (2, "b", "f")], "query_id long, removed string, added string")
    assert "".join(r.passage for r in L.apply_swaps(ranked, accepted).orderBy("rank").collect()) == "afcdebg"


def test_draws(spark):
    counts = {("a", "x"): 50, ("a", "y"): 30, ("b", "x"): 10, ("b", "y"): 10}
    taken = T.representative_draw(counts, [{"a": 80, "b": 20}, {"x": 60, "y": 40}], 20)
    assert sum(taken.values()) == 20 and abs(taken["a", "x"] + taken["a", "y"] - 16) <= 1 and abs(taken["a", "x"] + taken["b", "x"] - 12) <= 1
    assert taken == T.representative_draw(counts, [{"a": 80, "b": 20}, {"x": 60, "y": 40}], 20)
    assert sum(T.representative_draw(counts, [{"a": 80, "b": 20}, {"x": 60, "y": 40}], 500).values()) == 100
    rows = spark.createDataFrame([(i, "a" if i % 5 else "b", "x" if i % 3 else "y") for i in range(200)], "id long, g string, h string")
    assert T.draw(rows, ["g", "h"], "id", 30).count() == 30
    split = T.difficulty_split(rows, "g", "h", "id", 3).collect()
    assert len(split) == 3 and {r.cell for r in split} == {"a|x", "a|y", "b|any"}


def test_grid_cases_and_throughput(spark):
    data = {"d1": spark.range(3), "d2": spark.range(5)}
    out = T.grid(spark, data, {"count": lambda d: d.agg(F.count(F.lit(1)).alias("value")), "max": lambda d: d.agg(F.max("id").alias("value"))}, keep)
    assert {tuple(r) for r in out.collect()} == {("d1", "count", 3), ("d1", "max", 2), ("d2", "count", 5), ("d2", "max", 4)}
    reports = spark.createDataFrame([("r1", "m", {"recall_5": 0.123456})], "run string, method string, metrics map<string,double>")
    assert T.case_table(reports, ["recall_5", "f1"]).collect() == [("r1", "m", 0.1235, None)]
    assert [n for _, n in T.throughput(lambda: spark.range(7), 2)] == [7, 7]


def test_verification_in_steps(spark):
    from hopweave.operators import recovery as V

    ranked = spark.createDataFrame([(q, "Q", f"p{i}", f"text {q} {i}", i) for q in (1, 2, 3) for i in range(1, 8)], "query_id long, question string, passage string, text string, rank int")
    seen = spark.sparkContext.accumulator(0)

    def provider(prompts):
        seen.add(len(prompts))
        return ['{"answer": "A", "evidence": "e", "confidence": 0.9}' if "text 1 2" in p or "text 2 5" in p else "no" for p in prompts]

    out = {(r.query_id, r.passage) for r in V.verify_in_steps(ranked, provider, lambda h: h.where("confidence > 0.5"), keep).collect()}
    assert out == {(1, "p2"), (2, "p5")} and seen.value == 9 + 6
    beams = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.88), (2, "a", 0.9), (2, "b", 0.5)], "query_id long, beam_id string, score double")
    assert {(r.query_id, r.beam_id) for r in V.ambiguous(beams).collect()} == {(1, "a"), (1, "b"), (2, "a")}


def test_types_and_witnesses(spark):
    from hopweave.operators import recovery as V

    h = spark.createDataFrame([("Rome", "date"), ("1999", "date"), ("42", "person"), ("Ann", "person")], "answer string, answer_type string")
    assert [r.type_reason for r in V.typed(h).collect()] == ["not_a_time", None, "not_a_name", None]
    docs = spark.createDataFrame([("p", "Work X\nAnn, a poet, wrote Work X in 1950. Bob read it.")], "passage string, text string")
    rows = [("Who wrote Work X?", "Ann", "Ann a poet wrote Work X", "p"), ("When was Work X written?", "1960", "wrote Work X in 1950", "p"), ("Who sang it?", "Cy", "nothing like it", "p")]
    out = {r.answer: (r.evidence, r.witness) for r in V.witnessed(spark.createDataFrame(rows, "question string, answer string, evidence string, passage string"), docs).collect()}
    assert out["Ann"] == ("Ann, a poet, wrote Work X", "supported") and out["Cy"][1] == "unknown" and out.get("1960", (None, "unknown"))[1] == "unknown"


def test_plans_are_repaired_only_if_whole(spark):
    from hopweave.operators import recovery as V

    schema = "plan_id long, id string, question string, depends_on array<string>, answer string, passage string"
    nodes = [(p, "s1", "Who wrote Work X?", [], a, a and "p1") for p, a in ((1, "Ann"), (2, None), (3, None), (4, None), (5, None))]
    nodes = spark.createDataFrame(nodes, schema)
    questions = spark.createDataFrame([(p, "Who wrote Work X?") for p in range(1, 6)], "plan_id long, question string")
    asked = {2: "Who is the author of Work X?", 3: "Who wrote Work X?", 4: "Who did Zed meet?", 5: "Whose is Work X?"}

    def replan(failed):
        assert {r.plan_id for r in failed.collect()} == {2, 3, 4, 5}
        return spark.createDataFrame([(p, "s1", q, []) for p, q in asked.items()], "plan_id long, id string, question string, depends_on array<string>")

    def search(new):
        return new.withColumns({"answer": F.when(F.col("plan_id") == 2, "Ann"), "passage": F.when(F.col("plan_id") == 2, "p9")})

    out = {r.plan_id: (r.question, r.passage) for r in V.recover(questions, nodes, replan, search, keep).collect()}
    assert out == {1: ("Who wrote Work X?", "p1"), 2: (asked[2], "p9"), 3: ("Who wrote Work X?", None), 4: ("Who wrote Work X?", None), 5: ("Who wrote Work X?", None)}
    adopted = spark.createDataFrame([(1, "Work X"), (2, "Ann")], "plan_id long, bridge_answer string")
    assert V.fresh_bridges(adopted, questions).collect() == [(2, "Ann")]


def test_proposals_and_modes(spark):
    from hopweave.operators import recovery as V

    ranked = spark.createDataFrame([(q, f"p{i}", i, f"text {i}") for q in (1, 2) for i in range(1, 8)], "query_id long, passage string, rank int, text string")
    questions = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, question string")
    out = V.propose_swaps(ranked, questions, lambda ps: ['{"removed": 4, "added": 7, "quote": "text 7", "confidence": 0.8}' if "one" in p else '{"removed": 4, "added": 70}' for p in ps])
    assert out.collect() == [(1, "p4", "p7", "text 7", 0.8)]
    stages = {n: (lambda d, n=n: d.withColumn(n, F.lit(True))) for n in ("plan", "search", "verify", "decompose", "second_round", "select")}
    assert V.run_mode("budget_iterative", spark.range(1), stages, keep).columns == ["id", "search", "second_round", "verify"]
    with pytest.raises(ValueError, match="unknown mode"):
        V.run_mode("other", spark.range(1), stages, keep)


def test_command_line(spark, tmp_path, capsys):
    from hopweave import cli

    assert cli.main(["list"]) == 0 and "graph_info" in capsys.readouterr().out.split()
    assert cli.main(["run", "no_such", "--data", "x", "--out", "y"], spark) == 2
    assert cli.main(["run", "graph_info", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}"], spark) == 0
    assert spark.read.parquet(f"file://{tmp_path}/graph_info").count() == 1
    (tmp_path / "a.json").write_text('{"query_id": 1, "gold": "The Rome", "predicted": "rome"}\n{"query_id": 2, "gold": "a b", "predicted": "a c d"}\n')
    capsys.readouterr()
    assert cli.main(["score", f"file://{tmp_path}/a.json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 2, "em": 0.5, "f1": 0.5}


def test_keyed_records_and_hop_labels(spark, tmp_path):
    from hopweave.sources import questions as Q, tables

    (tmp_path / "q.json").write_text(json.dumps({"a": {"question": "one?", "id": "2hop__1"}, "b": {"question": "two?", "id": "x"}}))
    records = tables.keyed_questions(spark, f"file://{tmp_path}/q.json")
    assert {(r.key, r.question) for r in records.collect()} == {("a", "one?"), ("b", "two?")}
    answers = spark.createDataFrame([("one?", "x"), ("three?", "y")], "question string, predicted string")
    assert [(r.question, r.hops, r.predicted) for r in Q.write_hop_labels(records, answers, f"file://{tmp_path}/labels").collect()] == [("one?", 2, "x")]
