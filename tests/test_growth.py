"""Steps whose cost must not grow faster than their input."""

import itertools

from hopweave.functions import routing
from hopweave.plans import text_queries
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_words_of_a_question_are_read_once(spark):
    plan = _plan(text_queries.question_routes(spark, SMALL))
    assert plan.count("regexp_extract_all(") == 1 and "RepartitionByExpression [c_custkey" in plan
    asked = spark.createDataFrame([("Where was the founder of Alpha in Rome born?",), ("Are Alpha and the Beta 2 the same age as Rome?",), (None,), ("",)], "q string")
    found = asked.select(routing.route(F.col("q"), F.lit(2)).alias("r"), routing.structure(F.col("q")).alias("s"))
    assert [tuple(r) for r in found.collect()] == [("nested_bridge", "chain_or_unknown")] + [("chain_or_unknown",) * 2] * 3
    assert _plan(found).count("regexp_extract_all(") <= 2  # one for each of the two columns


def test_copies_of_vectors_leave_a_task_in_parts():
    import numpy as np
    import pyarrow as pa
    from hopweave.operators import angular

    rng = np.random.default_rng(3)
    unit, pivots = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(4000, 64)), rng.normal(size=(40, 64))))
    cell = angular._angles(unit, pivots).argmin(axis=1).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(cell), pa.array(np.full(4000, 0.1))], names=["id", "unit", "cell", "bound"])
    low, high = np.append(np.zeros(40), -1.0), np.append(np.full(40, np.pi), -1.0)
    parts = list(angular._sent(pivots, low, high, False, False)([batch]))
    counts = sum(b.column("n").to_numpy() for b in angular._sent(pivots, low, high, False, True)([batch]))
    assert sum(p.num_rows for p in parts) == counts.sum() > 100_000
    assert max(p.nbytes for p in parts) < 24 << 20


def test_best_sets_are_decided_where_their_candidates_lie(spark):
    from hopweave.operators import evidence as V
    from hopweave.plans import model_queries

    files = model_queries.best_sets(spark, SMALL).inputFiles()
    assert files and all(f.endswith(("lineitem.parquet", "orders.parquet")) for f in files)  # nothing is written between
    rows = [(1, "a", 1, 0.1), (1, "b", 2, 0.2), (1, "c", 3, 0.3), (1, "d", 0, 0.0), (2, "x", 1, 0.5), (2, "y", 1, 0.5), (2, "z", 1, 0.5), (2, "w", 1, 0.4)]
    got = {r.query_id: (r.mask, r.value, r.names) for r in V.best_sets(spark.createDataFrame(rows, "query_id long, name string, mask long, utility double"), 2).collect()}
    assert got == {1: (3, 0.5, ["b", "c"]), 2: (1, 1.0, ["x", "y"])}
    assert V.contenders([("x", 1, 0.5), ("y", 1, 0.5), ("z", 1, 0.5), ("w", 3, 0.1)], 2) == [("x", 1, 0.5), ("y", 1, 0.5), ("w", 3, 0.1)]


def test_neighbours_are_dealt_out_by_node_once(spark):
    from hopweave.operators import graph as G
    from hopweave.plans import graph_queries
    from hopweave.sources.tables import star_triples

    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    t = star_triples(spark, SMALL)
    assert exchanges(graph_queries.bridge_neighbours(spark, SMALL)) < exchanges(G.neighbours(G.fact_edges(t), G.entity_idf(t)))
    t = spark.createDataFrame([("c1", "a", "p", "b"), ("c2", "a", "q", "b"), ("c1", "a", "p", "a"), ("a", "a", "p", "c"), ("c3", "d", "p", "c"), ("c4", "e", "p", "e")], "chunk string, subj string, pred string, obj string")
    assert sorted(G.bridge_neighbours(t, 1).collect()) == sorted(G.neighbours(G.fact_edges(t), G.entity_idf(t), 1).collect())


def test_claims_are_judged_in_their_own_rows(spark):
    from hopweave.functions import grammar

    plan = _plan(text_queries.relation_checks(spark, SMALL))
    assert "Generate" not in plan and "RepartitionByExpression [claim_id" in plan  # no row for each sentence and form
    claims = [(1, "Where does Ann live?", "Rome", None), (2, "Where does Ann live?", "Rome", "Ann never lived in Rome. Ann lives in Paris."), (2, "Where does Ann live?", "Rome", "Ann lived in Rome."), (3, "How many sons does Ann have?", "two", "Ann has 3 sons."), (4, "Why?", "Rome", "")]
    got = grammar.check(spark.createDataFrame(claims, "claim_id int, question string, answer string, text string")).collect()
    assert {r.claim_id: (r.status, r.reason) for r in got} == {2: ("supported", "form"), 3: ("contradicted", "other_value"), 4: ("unknown", "relation_not_known")}


def test_texts_meet_phrases_where_they_are_read(spark, monkeypatch):
    found = text_queries.phrase_containment(spark, SMALL)
    plan = _plan(found)
    assert plan.count("Relation [doc_id") == 1 and plan.count("regexp_replace") <= 4
    rows = sorted(found.collect())
    monkeypatch.setattr(text_queries, "MOST_KEYS", 0)  # the way of many keys gives the same rows
    assert rows == sorted(text_queries.phrase_containment(spark, SMALL).collect()) != []


def test_products_leave_a_task_in_parts():
    import numpy as np
    import pyarrow as pa
    from hopweave.operators import graph as G

    rng = np.random.default_rng(4)
    matrix, rows = rng.normal(size=(300, 8)), rng.normal(size=(3000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(rows), pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    names = ["query_id", "vec_id", "raw", "low", "high"]
    parts = list(G._products(list(range(300)), matrix, 1000, names)([batch]))
    assert max(p.num_rows for p in parts) <= 100_000 and sum(p.num_rows for p in parts) == 300_000
    got = pa.Table.from_batches(parts).to_pydict()
    want = np.round(matrix @ rows.T, 6)
    assert np.array_equal(got["raw"], -np.sort(-want, axis=1)[:, :1000].ravel()) and got["query_id"] == list(np.repeat(range(300), 1000))
    assert np.array_equal(got["low"][::1000], want.min(axis=1))


def test_token_lists_are_sorted_a_few_rows_at_a_time():
    import pyarrow as pa
    from hopweave.operators import evaluation as E

    lists = pa.array([[1, 1, 2], [3], []] * 300, pa.list_(pa.int64()))
    other = pa.array([[1, 2, 2, 9], [], [4]] * 300, pa.list_(pa.int64()))
    parts = list(E._same_tokens([pa.RecordBatch.from_arrays([pa.array(range(900)), lists, other], names=["query_id", "g", "p"])]))
    assert max(p.num_rows for p in parts) <= 256
    assert pa.Table.from_batches(parts).to_pydict() == {"query_id": list(range(900)), "f1": [4 / 7, 0.0, 0.0] * 300}


def test_a_pool_is_trimmed_by_tasks_of_bounded_size(spark, monkeypatch):
    from hopweave.operators import ranking
    from hopweave.plans import graph_queries
    from hopweave.sources import shared

    rows = sorted(graph_queries.trim_pool(spark, SMALL).collect())
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    monkeypatch.setattr(ranking, "TASK_ROWS", 200)
    small = graph_queries.trim_pool(spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert _plan(small).count(f", {-(-lines // 200)}\n") == 3  # tasks by the number of rows
    assert sorted(small.collect()) == rows


def test_overwritten_edges_are_counted_from_their_own_triples(spark):
    from hopweave.operators import graph as G
    from hopweave.plans import graph_queries
    from hopweave.sources.tables import star_triples

    found = graph_queries.synonym_overwrite(spark, SMALL)
    below = _plan(found).split("Join FullOuter")[1].split("Aggregate")
    assert any("customer 1)" in part for part in below[2:])  # a filter of triples, below the sum
    edges = G.fact_edges(star_triples(spark, SMALL))
    every = G.merge_edges(edges, edges.where("src LIKE 'customer 1%'").withColumn("weight", F.lit(0.5)))
    assert sorted(found.collect()) == sorted(every.collect())


def test_sets_and_choices_are_made_once_for_plans_of_a_shape(spark, monkeypatch):
    from hopweave.operators import evidence as V
    from hopweave.sources.shared import keep

    worked = []

    def counted(df):
        out = keep(df)
        if "up" in df.columns and "held" in df.columns:
            worked.append(out.count())
        return out

    plans = spark.createDataFrame([(p, 3, [0, 1, None] if p % 2 else [0, 0]) for p in range(60)] + [(99, 2, [2, 0])], "plan_id long, n int, parents array<long>")
    sets = {(r.plan_id, r.mask, r.size) for r in V.closed_subsets(plans, counted).collect()}
    assert worked == [3]  # three shapes of 61 plans
    masks = [(p, m) for p in range(60) for m in range(1, 8) if not (p % 2 and m & 2 and not m & 1)] + [(99, 2), (99, 3)]
    assert sets == {(p, m, m.bit_count()) for p, m in masks}
    # Node 2 of even plans has no proof, one passage is null, and plan 99 has none at all.
    proofs = [(p, 0, f"a{p}", 0.5) for p in range(60)] + [(p, 1, None if p == 3 else f"b{p}", p / 100) for p in range(60)] + [(p, 2, c, 0.9) for p in range(1, 60, 2) for c in ("c", "d")]
    frame = spark.createDataFrame(proofs, "plan_id long, node int, passage string, quality double")
    worked.clear()
    rows = lambda: sorted((r.plan_id, r.mask, tuple(r.passages), r.quality) for r in V.packages(plans, frame, 3, counted).collect())
    got = rows()
    assert worked == [2]
    by_node = lambda p, i: [(c[2], c[3]) for c in proofs if c[:2] == (p, i)]
    want = []
    for p, m in masks[:-2]:
        for choice in itertools.product(*(by_node(p, i) for i in range(3) if m >> i & 1)):
            want.append((p, m, tuple(c[0] for c in choice if c[0]), min(c[1] for c in choice)))
    assert got == sorted(want)
    monkeypatch.setattr(V, "MOST_SETS", 0)  # the way of many shapes gives the same rows
    assert rows() == got


def test_lines_of_plans_are_dealt_out_once(spark, monkeypatch):
    from hopweave.operators import evidence as V
    from hopweave.plans import model_queries

    seen, chosen = [], V.chosen
    monkeypatch.setattr(V, "chosen", lambda plans: seen.append(plans) or chosen(plans))
    model_queries.proof_packages(spark, SMALL)
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
