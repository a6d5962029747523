"""Verdicts that two searches share, slot templates, and the retrieval ladder with all its stages."""

import pytest
from pyspark.sql import functions as F

from hopweave.operators import ranking as R, recovery as V, retrieval as S
from hopweave.sources import stores
from hopweave.sources.shared import keep
from tests.test_lifecycle import asked, index  # noqa: F401  fixtures

TEXTS = {"p1": "Ann wrote Work X.", "p2": "Ann was born in Rome.", "p3": "Bob lives in Oslo."}


def provider(asked_of):
    def run(prompts):
        out = []
        for p in prompts:
            asked_of.append(p)
            question, passage = p.split(" @ ")
            out.append({("Who is the author of Work X?", "p1"): "Ann", ("Where was Ann born?", "p2"): "Rome"}.get((question, passage), ""))
        return out

    return run


def test_a_recovery_asks_only_for_new_keys(spark, tmp_path):
    memo = stores.Versioned(spark, f"file://{tmp_path}/memo", V.MEMO)
    docs = spark.createDataFrame(list(TEXTS.items()), "passage string, text string")
    verify = lambda nodes: nodes.crossJoin(docs.select("passage")).withColumn("prompt", F.concat("question", F.lit(" @ "), "passage"))
    counts = []
    first = spark.createDataFrame([(2, "s1", "Who is the author of Work X?"), (2, "s1", "Who is the author of Work X?"), (3, "s1", "Who met Bob?")], "plan_id long, id string, question string")
    out = V.remembered(verify(first), ["question", "passage"], memo, provider([]), counts.append).collect()
    assert counts == [6] and len(out) == 9 and {r.response for r in out if r.passage == "p1" and r.plan_id == 2} == {"Ann"}
    schema = "plan_id long, id string, question string, depends_on array<string>, answer string, passage string"
    nodes = spark.createDataFrame([(p, "s1", "Where was the one who wrote Work X born?", [], None, None) for p in (2, 3)], schema)
    questions = spark.createDataFrame([(p, "Where was the one who wrote Work X born?") for p in (2, 3)], "plan_id long, question string")

    def replan(failed):
        templates = spark.createDataFrame(
            [(2, "s1", "Who is the author of Work X?", {}), (2, "s2", "Where was {{who}} born?", {"who": "s1"}), (3, "s1", "Who met Work X?", {}), (3, "s2", "Where is {{ who }}?", {"who": "s1"}), (3, "s3", "{{self}} {{gone}}?", {"self": "s3"})],
            "plan_id long, id string, template string, slots map<string,string>",
        )
        made = V.render_slots(templates)
        assert {(r.plan_id, r.id): (r.question, r.reason) for r in made.collect()} == {
            (2, "s1"): ("Who is the author of Work X?", None), (2, "s2"): ("Where was ${s1.answer} born?", None), (3, "s1"): ("Who met Work X?", None), (3, "s2"): ("Where is ${s1.answer}?", None), (3, "s3"): (None, "unknown_slot")}
        return made.where("reason IS NULL").drop("reason")

    counts.clear()
    got = {(r.plan_id, r.id): (r.answer, r.passage) for r in V.recover_in_rounds(questions, nodes, replan, verify, memo, provider([]), report=counts.append).collect()}
    assert got == {(2, "s1"): ("Ann", "p1"), (2, "s2"): ("Rome", "p2"), (3, "s1"): (None, None)}
    # The author question was answered by the search before: only "Who met Work X?" is new, then the bound second hop.
    assert counts[:2] == [3, 3] and sum(counts) == 6


def test_the_ladder_is_made_of_its_stages(spark, index, asked):  # noqa: F811
    subs = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (1, "b", [0.0, 0.8, 0.6])], "query_id long, sub_question string, embedding array<double>")
    out = S.retrieve(asked, index, top=4, mix=0.5, rounds=2, sub_queries=subs).collect()
    near = keep(S.fact_scores(asked, index, 5))
    seeds = {(r.query_id, r.entity): r.prob for r in S.path_seeds(asked, index, near, 0.5).collect()}
    assert all(abs(sum(p for (q, _), p in seeds.items() if q == k) - 1) < 1e-9 for k in (1, 2))
    ranked = keep(S.path_search(asked, index, 5, 4, 0.5, near))
    known = near.select("query_id", F.explode(F.array("subj", "obj")).alias("entity")).distinct()
    second = keep(S.second_round(ranked, asked, index, known, top=4))
    fused = R.top_k(R.fuse([(second.where("query_id = 1"), 0.7), (S.decomposed_track(subs, index, top=4), 0.3)]), 4, "query_id", "score", "passage")
    want = {(r.query_id, r["rank"]): (r.passage, r.score) for df in (fused, second.where("query_id = 2")) for r in df.collect()}
    assert {(r.query_id, r["rank"]): (r.passage, r.score) for r in out} == want and {r.route for r in out} == {"path"}


def test_hardly_worse_beams_stay(spark):
    beams = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.845), (2, "a", 0.9), (2, "b", 0.83)], "query_id long, beam_id string, score double")
    assert {(r.query_id, r.beam_id) for r in V.ambiguous(beams).collect()} == {(1, "a"), (1, "b"), (2, "a")}
