"""Prefixes of all queries at once against the rules over lists, and sets against all choices."""

import itertools
import random

from hopweave.operators import evidence as V, prefixes as X, selection as L
from hopweave.plans import model_queries
from hopweave.sources.shared import keep

DIR = "/root/testdata/sf0.001"
DEPENDS = {"g1": [], "g2": ["g1"], "g3": ["g2"], "g4": ["g1"]}


def pools(seed, queries=4):
    """Random pools, their base order and proofs; the last query has one passage and no proof."""
    rng = random.Random(seed)
    out = {}
    for q in range(queries):
        n = 1 if q == queries - 1 else rng.randrange(4, 11)
        pool = {f"p{i:02}": {"base": rng.randrange(16) / 16, "goals": {g: rng.randrange(9) / 8 for g in rng.sample(sorted(DEPENDS), rng.randrange(3))}, "tokens": set(rng.sample("abcdefgh", rng.randrange(1, 6)))} for i in range(n)}
        ranked = sorted(pool, key=lambda p: (-pool[p]["base"], p))
        proofs = [] if q == queries - 1 else [{"goal": g, "passage": p, "quality": rng.randrange(9) / 8, "accepted": rng.random() < 0.7} for g in DEPENDS for p in rng.sample(ranked, 2)]
        out[q] = (pool, ranked, proofs)
    return out


def frames(spark, data):
    pool = spark.createDataFrame([(q, n, p["base"], p["goals"], sorted(p["tokens"])) for q, (own, _, _) in data.items() for n, p in own.items()], "query_id long, passage string, base double, goals map<string,double>, tokens array<string>")
    ranked = spark.createDataFrame([(q, n, i) for q, (_, order, _) in data.items() for i, n in enumerate(order, 1)], "query_id long, passage string, rank int")
    proofs = spark.createDataFrame([(q, p["passage"], p["goal"], p["quality"], p["accepted"]) for q, (_, _, own) in data.items() for p in own], "query_id long, passage string, goal string, quality double, accepted boolean")
    plan = spark.createDataFrame([(q, g, n) for q in data for g, n in DEPENDS.items()], "query_id long, goal string, needs array<string>")
    return pool, ranked, proofs, plan


def orders(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append(r.passage)
    return out


def test_prefixes_match_the_rules_over_lists(spark):
    data = pools(1)
    pool, ranked, proofs, plan = frames(spark, data)
    lists = {q: {g: tuple(sorted(b)) for g, b in sorted(L.bundles(own, DEPENDS).items())} for q, (_, _, own) in data.items()}
    proven = keep(X.bundles(proofs, plan, keep))
    got = {}
    for r in proven.collect():
        got.setdefault(r.query_id, {})[r.goal] = tuple(r.bundle)
    assert got == {q: b for q, b in lists.items() if b}
    assert {r.query_id: list(r.passages) for r in X.joint_prefix(pool, proven, keep, 3).collect()} == {q: L.joint_prefix(own, lists[q], 3) for q, (own, _, _) in data.items()}
    assert orders(X.continuous_prefix(ranked, pool, proven, keep, 3)) == {q: L.continuous_prefix(order, own, lists[q], 3) for q, (own, order, _) in data.items()}
    assert orders(X.dependency_prefix(ranked, proofs, plan, keep, 4)) == {q: L.dependency_prefix(order, own, DEPENDS, 4) for q, (_, order, own) in data.items()}


def test_queries_match_the_rules_over_lists(spark):
    pool, ranked, proofs, plan = (x.collect() for x in model_queries._proven(spark, DIR))
    needs = {r.goal: list(r.needs) for r in plan}
    for q in sorted({r.query_id for r in pool})[:4]:
        own = {r.passage: {"base": r.base, "goals": dict(r.goals), "tokens": set(r.tokens)} for r in pool if r.query_id == q}
        order = [r.passage for r in sorted(ranked, key=lambda r: r["rank"]) if r.query_id == q]
        shown = [r.asDict() for r in proofs if r.query_id == q]
        proven = {g: tuple(sorted(b)) for g, b in sorted(L.bundles(shown, needs).items())}
        if q == min(r.query_id for r in pool):
            joint = {r.query_id: list(r.passages) for r in model_queries.joint_prefix(spark, DIR).collect()}
            continuous, dependent = orders(model_queries.continuous_prefix(spark, DIR)), orders(model_queries.dependency_prefix(spark, DIR))
        assert joint[q] == L.joint_prefix(own, proven)
        assert continuous[q] == L.continuous_prefix(order, own, proven) and dependent[q] == L.dependency_prefix(order, shown, needs)


def test_best_sets_match_the_list_program(spark):
    rng = random.Random(3)
    rows = {q: [(f"c{i:02}", rng.randrange(1, 32), rng.randrange(8) / 8) for i in range(n)] for q, n in ((1, 13), (2, 1), (3, 8))}
    frame = spark.createDataFrame([(q, *c) for q, cs in rows.items() for c in cs], "query_id long, name string, mask long, utility double")
    got = {r.query_id: (r.mask, r.value, tuple(r.names)) for r in V.best_sets(frame, 4).collect()}
    assert got == {q: V.best_set(cs, 4) for q, cs in rows.items()}


def test_packages_match_all_choices(spark):
    parents = {1: [0, 1, 0, 6], 2: [0]}
    proofs = {1: {0: [("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6)], 1: [("e", 0.5)], 2: [], 3: [("f", 0.4)]}, 2: {0: [("x", 1.0)]}}
    plans = spark.createDataFrame([(p, len(m), m) for p, m in parents.items()], "plan_id long, n int, parents array<long>")
    frame = spark.createDataFrame([(p, n, *c) for p, nodes in proofs.items() for n, cs in nodes.items() for c in cs], "plan_id long, node int, passage string, quality double")
    want = set()
    for p, masks in parents.items():
        for mask in range(1, 1 << len(masks)):
            held = [i for i in range(len(masks)) if mask >> i & 1]
            if all(masks[i] & mask == masks[i] for i in held):
                for choice in itertools.product(*(sorted(proofs[p][i], key=lambda c: (-c[1], c[0]))[:3] for i in held)):
                    want.add((p, mask, tuple(c[0] for c in choice), min(c[1] for c in choice)))
    assert {(r.plan_id, r.mask, tuple(r.passages), r.quality) for r in V.packages(plans, frame).collect()} == want
