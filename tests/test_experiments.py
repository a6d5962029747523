import json

import pytest
from pyspark.sql import functions as F

from hopweave.functions import routing
from hopweave.operators import experiments as X
from hopweave.sources import questions as Q
from hopweave.sources.tables import questions


def test_question_records(spark, tmp_path):
    records = [
        {"id": "2hop__1", "question": "a", "answer": "x", "answer_aliases": ["y"], "question_decomposition": [{"question": "q"}] * 3, "paragraphs": [{"title": "T", "paragraph_text": "p", "is_supporting": True}, {"title": "U", "paragraph_text": "q", "is_supporting": False}]},
        {"_id": "5", "question": "b", "answer": "z", "supporting_facts": [{"title": "S", "sent_id": 0}], "context": [{"title": "S", "sentences": ["m", "n"]}, {"title": "V", "sentences": ["o"]}]},
        {"question": "c", "obj": "politician", "possible_answers": "[\"politician\", \"political leader\"]", "o_aliases": "[\"political figure\"]"},
    ]
    (tmp_path / "q.json").write_text(json.dumps(records))
    df = questions(spark, str(tmp_path / "q.json"))
    assert {r.question: r.h for r in df.select("question", Q.infer_hops().alias("h")).collect()} == {"a": 3, "b": 1, "c": None}
    assert [r.h for r in df.where("question = 'a'").select(Q.hop_label("musique").alias("h")).collect()] == [3]
    assert {(r.question, r.passage) for r in Q.gold_passages(df, "").collect()} == {("a", "T\np"), ("b", "S\nmn")}
    assert {r.question: r.answers for r in Q.gold_answers(df).collect()} == {"a": ["x", "y"], "b": ["z"], "c": ["political figure", "political leader", "politician"]}


def test_detailed_rows(spark):
    ranked = spark.createDataFrame([(1, f"p{i}", i + 1) for i in range(200)], "query_id long, passage string, rank int")
    gold = spark.createDataFrame([(1, "p0"), (1, "p8"), (1, "p100")], "query_id long, passage string")
    r = X.detailed_rows(ranked, gold).first()
    assert r.gold_ranks == [1, 9, 101] and round(r.recall_5, 6) == 0.333333 and r.docs == [f"p{i}" for i in range(10)] and len(r.candidate_docs) == 200 and not r.all_gold_top10


def test_samples_and_frozen_inputs(spark, tmp_path):
    rows = spark.range(100).withColumn("hops", F.col("id") % 3)
    assert X.select_samples(rows, "id", size=7).count() == 7 and [r.id for r in X.select_samples(rows, "id", [4, 2]).orderBy("id").collect()] == [2, 4]
    with pytest.raises(ValueError):
        X.select_samples(rows, "id", [100])
    assert X.stratified_indices(rows, ["hops"], "id", 10).count() == 10
    key = X.freeze(rows, str(tmp_path / "f"))
    assert X.replay(spark, str(tmp_path / "f"), key).count() == 100
    with pytest.raises(ValueError):
        X.replay(spark, str(tmp_path / "f"), "other")


def test_audits_and_targets(spark):
    calls = spark.createDataFrame([(1, 3), (1, 4), (2, 1)], "query_id long, n int")
    pool = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, passage string")
    other = spark.createDataFrame([(1, "a"), (2, "c")], "query_id long, passage string")
    assert {(r.query_id, r.issue) for r in X.control_audit(calls, pool, other, 5).collect()} == {(1, "over_budget"), (2, "other_pool")}
    d = spark.createDataFrame([("x", 0.5, 0.62), ("y", 0.95, 0.94)], "dataset string, base double, value double")
    out = {r.dataset: (r.reached, r.unreachable, r.regressed) for r in X.target_assessment(d, 0.1).collect()}
    assert out == {"x": (True, False, False), "y": (False, True, True)}


def test_routing(spark):
    asked = {
        "Which is older, Alpha Tower or Beta Hall?": "parallel_comparison", "Are the directors of films Alpha and Beta from the same country?": "bridge_comparison",
        "When were Alpha and Beta founded?": "parallel_attribute", "Where was the writer of Work X born?": "chain_or_unknown", "What nationalities are Ann Bly and Cy Dow?": "parallel_attribute",
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.s for r in df.select("q", routing.structure(F.col("q")).alias("s")).collect()} == asked
