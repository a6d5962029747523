"""Hand-computed fixtures: the small graph, evidence checks, selections, providers, streaming, sampling."""

import json
import math

import pytest
from pyspark.sql import functions as F

from hopweave.functions import relations, repair, text as X
from hopweave.operators import evaluation as E, evidence as V, graph as G, providers as P, ranking as R
from hopweave.sources import tables as S
from hopweave.sources.shared import keep
from hopweave.streaming.ingest import check_digests, ingest_passages

FACTS = [("c1", "alice", "born in", "paris"), ("c1", "alice", "works in", "paris"), ("c1", "alice", "is", "alice"), ("c2", "alice", "visited", "paris"), ("c2", "alice", "visited", "berlin")]


@pytest.fixture()
def triples(spark):
    return spark.createDataFrame(FACTS, "chunk string, subj string, pred string, obj string")


def test_small_graph(triples):
    edges = {(r.src, r.dst): r.weight for r in G.fact_edges(triples).collect()}
    assert edges == {("alice", "paris"): 3, ("paris", "alice"): 3, ("alice", "berlin"): 1, ("berlin", "alice"): 1}
    assert G.passage_edges(triples).count() == 5
    idf = {r.entity: (r.df, round(r.idf, 6)) for r in G.entity_idf(triples).collect()}
    assert idf == {"alice": (2, 1.0), "paris": (2, 1.0), "berlin": (1, 1.405465)}


@pytest.mark.parametrize("damping, want", [(0.5, (0.621722, 0.071494, 0.206842, 0.044014, 0.055929)), (0.85, (0.446506, 0.103529, 0.284310, 0.068161, 0.097494))])
def test_pagerank_reaches_the_fixed_point(spark, triples, damping, want):
    edges = G.fact_edges(triples).withColumn("weight", F.col("weight").cast("double")).unionByName(G.passage_edges(triples))
    reset = spark.createDataFrame([(1, "alice", 1.0), (1, "berlin", -3.0), (1, "paris", float("nan"))], "query_id long, node string, weight double")
    steps = 20 if damping == 0.5 else 50
    out = {r.node: r.score for r in G.personalised_pagerank(edges, reset, damping, steps, keep).collect()}
    assert [round(out[n], 5) for n in ("alice", "berlin", "paris", "c1", "c2")] == [round(x, 5) for x in want]


def test_synonym_precedence_and_delete(spark, triples):
    syn = spark.createDataFrame([("alice", "paris", 0.9)], "src string, dst string, weight double")
    assert {(r.src, r.dst): r.weight for r in G.merge_edges(G.fact_edges(triples), syn).collect()}[("alice", "paris")] == 0.9
    assert {(r.src, r.dst): r.weight for r in G.merge_edges(G.fact_edges(triples), syn, "max").collect()}[("alice", "paris")] == 3.0
    stay, orphans = G.delete_chunks(triples, spark.createDataFrame([("c2",)], "chunk string"))
    assert stay.count() == 3 and [r.entity for r in orphans.collect()] == ["berlin"]


def test_evaluation_strata(spark):
    rows = spark.createDataFrame([(0, 4, 0.0), (1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "query_id long, hops int, em double")
    out = {r.hops: (r.n, r.em) for r in E.stratified(rows, ["em"]).collect()}
    assert out == {None: (4, 0.75), 1: (1, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (1, 0.0)}
    ranked = spark.createDataFrame([(1, f"p{i}", i + 1) for i in range(200)], "query_id long, passage string, rank int")
    gold = spark.createDataFrame([(1, "p0"), (1, "p8"), (1, "p19")], "query_id long, passage string")
    r = E.recall_at(ranked, gold).first()
    assert (round(r.recall_5, 6), round(r.recall_10, 6), r.recall_200) == (0.333333, 0.666667, 1.0)
    assert sorted(x.rank for x in E.gold_ranks(ranked, gold).collect()) == [1, 9, 20]


def test_quotas_and_bootstrap(spark):
    assert E.quotas({"bridge": 800, "comparison": 200}, 60) == {"bridge": 48, "comparison": 12}
    assert sum(E.quotas({"a": 1, "b": 2, "c": 997}, 10, 1).values()) == 10
    rows = spark.createDataFrame([("s", float(i % 3), i) for i in range(60)], "stratum string, d double, row_id long")
    out = E.bootstrap_interval(rows, 300).first()
    assert 0.6 < out.low < 1.0 < out.high < 1.4


def test_hypotheses(spark):
    docs = spark.createDataFrame([(0, "Alpha wrote Work X in 1990."), (1, "Alpha was born in Rome in 1960.")], "doc_id long, text string")
    rows = [(0, "Alpha", "Alpha wrote Work X", "0.9", None), (5, "Alpha", "Alpha wrote Work X", "0.9", "unknown_document_reference"), (0, " ", "Alpha wrote Work X", "0.9", "invalid_answer_or_hash"),
            (0, "entity-" + "a" * 32, "Alpha wrote Work X", "1", "invalid_answer_or_hash"), (0, "Beta", "Alpha wrote Work X", "0.9", "answer_not_supported_in_quote"), (1, "Alpha", "Alpha", "0.9", "evidence_not_exact_substring"),
            (0, "Alpha", "Alpha wrote Work X", "nan", "low_claimed_confidence"), (0, "Alpha", "Alpha wrote Work X", "x", "low_claimed_confidence")]
    h = spark.createDataFrame(rows, "doc_id long, answer string, evidence string, confidence string, want string")
    assert all(r.reason == r.want for r in V.hypothesis_reasons(h, docs).collect())


def test_deep_and_large_plans(spark):
    chain = [(1, f"n{i}", [f"n{j}" for j in (i - 1, i - 3) if j >= 0]) for i in range(40)] + [(2, "a", ["gone"]), (2, "b", ["a", "c"]), (2, "c", []), (3, "s", ["s"]), (3, "t", ["s"])]
    nodes = spark.createDataFrame(chain, "plan_id long, id string, depends_on array<string>")
    depth = {(r.plan_id, r.id): r.depth for r in V.plan_depths(nodes, keep).collect()}
    assert all(depth[1, f"n{i}"] == i for i in range(40))
    assert depth[2, "c"] == 0 and depth[2, "a"] is None and depth[2, "b"] is None and depth[3, "s"] is None and depth[3, "t"] is None
    up = {(r.plan_id, r.id, r.ancestor) for r in V.ancestors(nodes, keep).collect()}
    assert {(i, j) for p, i, j in up if p == 1} == {(f"n{i}", f"n{j}") for i in range(40) for j in range(i)}
    assert {(2, "a", "gone"), (2, "b", "gone"), (2, "b", "c"), (3, "s", "s"), (3, "t", "s")} <= up
    parents = [[0] + [1 << (i - 1) for i in range(1, 13)], [0] * 13]
    plans = spark.createDataFrame([(1, 13, parents[0]), (2, 13, parents[1])], "plan_id long, n int, parents array<int>")
    out = V.closed_subsets(plans).collect()
    assert sorted(r.mask for r in out if r.plan_id == 1) == [(1 << i) - 1 for i in range(1, 14)] and sum(r.plan_id == 2 for r in out) == (1 << 13) - 1
    long = [0] + [1 << (i - 1) for i in range(1, 62)]
    ring = [2, 1, 2]  # two nodes that need each other, and one that needs them
    wide = spark.createDataFrame([(1, 62, long), (2, 3, ring), (3, 14, [0] * 14)], "plan_id long, n int, parents array<long>")
    out = V.closed_subsets(wide).collect()
    assert sorted(r.mask for r in out if r.plan_id == 1) == [(1 << i) - 1 for i in range(1, 63)]
    assert sorted(r.mask for r in out if r.plan_id == 2) == [3, 7] and sum(r.plan_id == 3 for r in out) == (1 << 14) - 1
    with pytest.raises(Exception, match="more than 62 nodes"):
        V.closed_subsets(spark.createDataFrame([(1, 63, [0] * 63)], "plan_id long, n int, parents array<long>")).collect()


def test_plans(spark):
    nodes = spark.createDataFrame([(1, "a", []), (1, "b", ["a"]), (1, "c", ["a", "b"]), (2, "x", ["y"]), (2, "y", ["x"])], "plan_id long, id string, depends_on array<string>")
    depth = {(r.plan_id, r.id): r.depth for r in V.plan_depths(nodes, keep).collect()}
    assert depth == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "x"): None, (2, "y"): None}
    up = {(r.id, r.ancestor) for r in V.ancestors(nodes.where("plan_id = 1"), keep).collect()}
    assert up == {("b", "a"), ("c", "a"), ("c", "b")}
    assert V.best_set([("a", 1, 0.5), ("b", 3, 0.1), ("c", 4, 0.2)], 2) == (7, pytest.approx(0.3), ("b", "c"))


def test_ties_go_by_name(spark):
    paths = spark.createDataFrame([(1, p, [p], 0.5, ["z"]) for p in ("p-c", "p-a", "p-b")], "query_id long, passage string, nodes array<string>, total double, targets array<string>")
    assert [r.passage for r in V.greedy_paths(paths, 2).orderBy("step").collect()] == ["p-a", "p-b"]
    df = spark.createDataFrame([(1, e, 1.0) for e in "cba"], "query_id long, entity string, s double")
    assert [r.entity for r in R.top_k(df, 2, "query_id", "s", "entity").orderBy("rank").collect()] == ["a", "b"]


def test_text_functions(spark):
    row = spark.createDataFrame([("The Café, located-in  PARIS!", "Where is ${s1.answer}?", {"s1": "Rome"})], "a string, q string, b map<string,string>")
    out = row.select(X.ascii_norm(F.col("a")), X.answer_norm(F.col("a")), X.bind_placeholders(F.col("q"), F.col("b")), X.bind_placeholders(F.lit("${s2.answer}"), F.col("b")), X.subject_members(F.lit("Ann, Bob and Cy"))).first()
    assert list(out) == ["the caf   located in  paris", "café locatedin paris", "Where is Rome?", None, ["Ann", "Bob", "Cy"]]


def test_python_functions():
    assert repair.strip_accents("Ｃafé  Straße") == "cafe strasse"
    assert repair.repair_json('```json\n{"a": [1, 2, {"b": "x"') == {"a": [1, 2, {"b": "x"}]}
    assert repair.repair_json('{"a": 1, "b": tru') == {"a": 1} and repair.repair_json("no") is None
    assert repair.repair_json('{"a": [1, 2], "b": {x' + ", y" * 80) == {"a": [1, 2], "b": {}} or repair.repair_json('{"a": [1, 2], "b": {x' + ", y" * 80) == {"a": [1, 2]}
    assert repair.list_field('noise {"x": 1} {"triples": [["a","b","c"]]}', "triples") == [["a", "b", "c"]]
    assert repair.closest(["alpha wrot x"], ["beta ate y", "alpha wrote x"]) == ["alpha wrote x"]
    text = "word " * 200
    spans = repair.windows(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b > c for (_, b), (c, _) in zip(spans, spans[1:])) and repair.windows("word " * 2000) is None
    assert "".join("One. Two!\nThree"[a:b] for a, b in repair.source_units("One. Two!\nThree")) == "One. Two!\nThree"
    assert repair.entails("Title\nAnn and Bob met.", "Ann and Bob", "ann and bob met") == (True, "supported")


def test_relations():
    doc = "Work X\nAlpha wrote Work X in 1990. Beta liked it."
    assert relations.relation_of("Who wrote Work X?") == relations.Relation("author", "Work X")
    assert relations.witness("Who wrote Work X?", "Alpha", "Alpha wrote Work X", doc)[0] == "supported"
    assert relations.witness("Who wrote Work X?", "Beta", "Alpha wrote Work X", doc)[0] == "unknown"
    assert relations.typed_reason("soon", "date") == "not_a_time" and relations.typed_reason("Rome", "place") is None
    assert relations.repair_reason('Who made 3 of "Abc"?', [{"question": "Who made Abc?"}]) == "number_lost"
    assert relations.recovery_kind([{"id": "a", "depends_on": []}, {"id": "b", "depends_on": ["a"]}], {"a"}) == "terminal_missing"


def test_queue_resumes_and_publishes(spark):
    passages = spark.createDataFrame([("Alpha was here. Beta is there.",), ("nothing",)], "passage string")
    rows = P.run_queue(passages, P.rule_extractor, keep)
    assert {r.passage: (r.status, len(r.triples)) for r in rows.collect()} == {"nothing": ("empty_valid", 0), "Alpha was here. Beta is there.": ("success", 2)}
    broken = P.run_queue(passages, lambda texts: ["not json"] * len(texts), keep, 2)
    assert broken.count() == 2 and P.publish(broken, False).where("size(triples) > 0").isEmpty()
    with pytest.raises(ValueError):
        P.publish(broken, True)


def test_cache_asks_once(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, prompt string")
    empty = spark.createDataFrame([], "key string, response string")
    hits, fresh = P.cached(prompts, empty, P.rule_extractor, "1")
    assert fresh.count() == 2 and not any(r.hit for r in hits.collect())
    assert all(r.hit for r in P.cached(prompts, fresh, P.rule_extractor, "1")[0].collect())
    assert not any(r.hit for r in P.cached(prompts, fresh, P.rule_extractor, "2")[0].collect())


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda df: df.select("chunk", F.lit("a").alias("subj"))

    def run():
        stream = spark.readStream.schema("passage string").json(source)
        ingest_passages(stream, root, str(tmp_path / "check"), make).awaitTermination()
        return spark.read.parquet(f"{root}/triples").count()

    spark.createDataFrame([("p1",), ("p2",)], "passage string").write.json(source)
    assert run() == 2
    spark.createDataFrame([("p2",), ("p3",)], "passage string").write.mode("append").json(source)
    assert run() == 3
    old = spark.createDataFrame([("c", "x")], "chunk string, digest string")
    with pytest.raises(ValueError):
        check_digests(old, spark.createDataFrame([("c", "y")], "chunk string, digest string"))


def test_sources(spark, tmp_path):
    record = [{"_id": "1", "question": "Q?", "context": [{"title": "T", "sentences": ["a", "b"]}, {"title": "T", "sentences": ["a", "b"]}]}]
    (tmp_path / "q.json").write_text(json.dumps(record))
    q = S.questions(spark, str(tmp_path / "q.json")).withColumn("sample_idx", F.lit(0))
    assert [r.passage for r in S.sample_passages(q, "").collect()] == ["T\nab"]
    v = spark.createDataFrame([("h1", "x", [1.0, 0.0])], "hash_id string, content string, embedding array<double>")
    S.append_vectors(v, str(tmp_path), "entity")
    S.append_vectors(v.withColumn("hash_id", F.lit("h2")), str(tmp_path), "entity")
    assert S.vector_store(spark, str(tmp_path), "entity").count() == 2
    logs = spark.createDataFrame([('x "POST /v1/chat/completions HTTP/1.1" 200',), ('"POST /v1/chat/completions HTTP/1.1" 503',)], "value string")
    assert {r.code: r["count"] for r in S.http_status_counts(logs).collect()} == {"200": 1, "503": 1}


def test_knn_matches_plain_cosines(spark):
    rows = [(i, [math.cos(i), math.sin(i), 0.1 * i]) for i in range(30)]
    out = {(r.src, r.rank): r.dst for r in G.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    for i, v in rows:
        want = sorted((j for j, _ in rows if j != i), key=lambda j: (-round(cos(v, rows[j][1]), 6), j))[:3]
        assert [out[i, k] for k in (1, 2, 3)] == want
