"""Steps that exchange no more than their callers ask for."""

import re

from hopweave.operators import graph as G
from hopweave.plans import graph_queries
from pyspark.sql import functions as F

TRIPLES = [("c1", "order 1", "placed by", "customer 1"), ("c1", "order 1", "contains", "part 1"), ("c2", "order 2", "placed by", "customer 1"), ("c3", "part 1", "supplied by", "supplier 1"), ("c4", "part 2", "supplied by", "supplier 1")]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hash_ids_are_made_after_equal_triples_fell_together(spark):
    keys = re.findall(r"Aggregate \[([^\]]*)\]", _plan(graph_queries.hash_ids(spark, "/root/testdata/sf0.001")))
    assert len(keys) == 1 and "_id#" not in keys[0] and "subj#" in keys[0]


def test_frequencies_of_asked_entities_count_all_chunks(spark):
    t = spark.createDataFrame(TRIPLES, "chunk string, subj string, pred string, obj string")
    some = lambda c: c.startswith("customer ")
    assert G.entity_idf(t, some).collect() == G.entity_idf(t).where(some(F.col("entity"))).collect()
    assert sorted(G.bridge(t, some).collect()) == sorted(G.bridge(t).where(some(F.col("entity"))).collect())


def test_orphans_in_one_pass(spark):
    t = spark.createDataFrame(TRIPLES, "chunk string, subj string, pred string, obj string")
    orphans = G.delete_chunks(t, spark.createDataFrame([("c1",), ("c4",), ("c4",), ("none",)], "chunk string"))[1]
    assert sorted(r.entity for r in orphans.collect()) == ["order 1", "part 2"]
    assert _plan(orphans).count("Join") == 1
