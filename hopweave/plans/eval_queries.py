"""Evaluation, weights and sampling over the driver's tables. A customer's question is answered by ranked orders; gold are
those of high price."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from hopweave.operators import evaluation as E
from hopweave.plans.registry import query
from hopweave.plans.text_queries import ANSWER
from hopweave.sources.tables import table

RANKED = """ranked AS (SELECT o_custkey AS query_id, o_orderkey AS passage, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders),
  gold AS (SELECT o_custkey AS query_id, o_orderkey AS passage FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_totalprice > 400000)"""
_HITS = ", ".join(f"coalesce(count(*) FILTER (rank <= {k})::DOUBLE / count(*), 0) AS recall_{k}" for k in E.KS)
RECALL = RANKED + f""", found AS (SELECT g.query_id, {_HITS} FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN ranked r USING (query_id, passage) GROUP BY 1),
  recalls AS (SELECT q.query_id, {', '.join(f'coalesce(recall_{k}, 0)::DOUBLE AS recall_{k}' for k in E.KS)} FROM (SELECT DISTINCT query_id FROM ranked) q LEFT JOIN found USING (query_id))"""


def _ranked(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("passage"), rank.alias("rank"))


def _gold(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("passage"))
    return one.unionByName(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("query_id"), (-F.col("o_orderkey")).alias("passage")))


def _recalls(spark, sf_dir):
    return E.recall_at(_ranked(spark, sf_dir), _gold(spark, sf_dir))


def _sql6(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_NAMES = [f"recall_{k}" for k in E.KS]


@query(f"WITH {RECALL} SELECT query_id, {_sql6(_NAMES)} FROM recalls")
def recall_at_k(spark, sf_dir):
    return _recalls(spark, sf_dir).select("query_id", *[F.round(n, 6).alias(n) for n in _NAMES])


@query(f"WITH {RECALL} SELECT count(*)::BIGINT AS n, {', '.join(f'round(avg({x}), 4) AS {x}' for x in _NAMES)} FROM recalls")
def macro_recall(spark, sf_dir):
    return _recalls(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 4).alias(x) for x in _NAMES])


@query(f"WITH {RANKED} SELECT query_id, passage, rank::INT AS rank FROM (SELECT DISTINCT * FROM gold) LEFT JOIN ranked USING (query_id, passage)")
def gold_ranks(spark, sf_dir):
    return E.gold_ranks(_ranked(spark, sf_dir), _gold(spark, sf_dir))


@query(f"WITH {RECALL} SELECT CASE WHEN recall_5 >= 1 - 1e-12 THEN 'top5' WHEN recall_10 >= 1 - 1e-12 THEN 'top10' WHEN recall_200 >= 1 - 1e-12 THEN 'top200' ELSE 'missing200' END AS difficulty, count(*)::BIGINT AS n FROM recalls GROUP BY 1")
def historical_difficulty(spark, sf_dir):
    return _recalls(spark, sf_dir).groupBy(E.difficulty().alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = "answers AS (SELECT a.doc_id AS query_id, b.text AS gold, a.text AS predicted FROM documents a JOIN documents b ON b.doc_id IN (a.doc_id + 1, a.doc_id - 3) UNION ALL SELECT doc_id, text || ' !', 'the ' || text FROM documents WHERE lang = 'en')"


def _answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pairs = d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("predicted"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") - 3)).alias("other"))
    near = pairs.join(d.select(F.col("doc_id").alias("other"), F.col("text").alias("gold")), "other").select("query_id", "gold", "predicted")
    return near.unionByName(d.where("lang = 'en'").select(F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" !")).alias("gold"), F.concat(F.lit("the "), "text").alias("predicted")))


@query(f"WITH {_ANSWERS} SELECT query_id, max(CASE WHEN {ANSWER.format('gold')} = {ANSWER.format('predicted')} THEN 1 ELSE 0 END)::INT AS em FROM answers GROUP BY 1")
def exact_match(spark, sf_dir):
    return E.exact_match(_answers(spark, sf_dir))


@query(
    f"""WITH {_ANSWERS}, n AS (SELECT query_id, gold, predicted, list_filter(string_split({ANSWER.format('gold')}, ' '), lambda x: x <> '') AS g, list_filter(string_split({ANSWER.format('predicted')}, ' '), lambda x: x <> '') AS p FROM answers),
    s AS (SELECT query_id, gold, token, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM (SELECT query_id, gold, unnest(g) AS token, 1 AS side FROM n UNION ALL SELECT query_id, gold, unnest(p), 2 FROM n) GROUP BY ALL),
    f AS (SELECT query_id, gold, sum(least(a, b)) AS same FROM s GROUP BY ALL)
    SELECT n.query_id, round(max(coalesce(2.0 * same / (len(g) + len(p)), 0)), 6) AS f1 FROM n LEFT JOIN f USING (query_id, gold) GROUP BY 1"""
)
def token_f1(spark, sf_dir):
    return E.token_f1(_answers(spark, sf_dir))


_STRATA = RECALL + ", strata AS (SELECT r.*, (1 + query_id % 4)::BIGINT AS hops FROM recalls r)"


@query(f"WITH {_STRATA} SELECT hops, count(*)::BIGINT AS n, round(avg(recall_1), 4) AS recall_1, round(avg(recall_5), 4) AS recall_5 FROM strata GROUP BY GROUPING SETS ((), (hops))")
def stratified_grouping_sets(spark, sf_dir):
    return E.stratified(_recalls(spark, sf_dir).withColumn("hops", 1 + F.col("query_id") % 4), ["recall_1", "recall_5"])


_POP = "pop AS (SELECT c_custkey, c_mktsegment AS s, c_acctbal FROM customer), smp AS (SELECT * FROM pop WHERE c_acctbal > 8000 OR (s = 'BUILDING' AND c_acctbal > 4000)), w AS (SELECT s, p.size, m.n, p.size::DOUBLE / (SELECT count(*) FROM pop) / m.n AS weight FROM (SELECT s, count(*)::BIGINT AS size FROM pop GROUP BY 1) p JOIN (SELECT s, count(*)::BIGINT AS n FROM smp GROUP BY 1) m USING (s))"


def _pop(spark, sf_dir):
    pop = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("s"), "c_acctbal")
    return pop, pop.where("c_acctbal > 8000 OR (s = 'BUILDING' AND c_acctbal > 4000)")


@query(f"WITH {_POP} SELECT s, size, n, round(weight, 9) AS weight FROM w")
def poststrat_weights(spark, sf_dir):
    return E.poststratification(*_pop(spark, sf_dir), "s").withColumn("weight", F.round("weight", 9))


@query(f"WITH {_POP} SELECT round(sum(weight * c_acctbal) / sum(weight), 6) AS c_acctbal, round(power(sum(weight), 2) / sum(weight * weight), 6) AS ess FROM smp JOIN w USING (s)")
def weighted_metrics(spark, sf_dir):
    pop, sample = _pop(spark, sf_dir)
    return E.weighted_means(sample, E.poststratification(pop, sample, "s"), "s", ["c_acctbal"])


@query(f"WITH {RECALL}, b AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN recall_5 ELSE recall_10 END AS y, recall_5 AS x FROM recalls) SELECT count(*)::BIGINT AS n, 0::BIGINT AS unmatched, round(avg(y - x), 6) AS mean_difference, count(*) FILTER (y - x > 1e-12)::BIGINT AS wins, count(*) FILTER (y - x < -1e-12)::BIGINT AS losses, count(*) FILTER (abs(y - x) <= 1e-12)::BIGINT AS ties FROM b")
def bootstrap_point(spark, sf_dir):
    r = _recalls(spark, sf_dir)
    other = r.select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("recall_5")).otherwise(F.col("recall_10")).alias("recall_5"))
    return E.paired(r, other, "recall_5")


@query()
def bootstrap_interval(spark, sf_dir):
    r = _recalls(spark, sf_dir).select((F.col("query_id") % 4).alias("stratum"), (F.col("recall_10") - F.col("recall_5")).alias("d"), F.col("query_id").alias("row_id"))
    return E.bootstrap_interval(r)


@query("SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1031:' || c_custkey), c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE place <= greatest(least(2, n), floor(0.1 * n))")
def stratified_subset(spark, sf_dir):
    return E.stratified_subset(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.1)


@query("WITH d AS (SELECT n_name AS dataset, avg(c_acctbal) / 1e5 - 0.02 AS d5, avg(c_acctbal) / 2e5 AS d10, 0.01 AS d_all5 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT round(avg(0.6 * d5 + 0.25 * d10 + 0.15 * d_all5), 6) AS score, avg(d5) > 0 AND avg(d10) >= 0 AND min(d5) >= -0.02 AS eligible FROM d")
def improvement_score(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = c.groupBy(F.col("n_name").alias("dataset")).agg((F.avg("c_acctbal") / 1e5 - 0.02).alias("d5"), (F.avg("c_acctbal") / 2e5).alias("d10"), F.lit(0.01).alias("d_all5"))
    return E.improvement_score(d)


@query("SELECT lang AS feature, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1 UNION ALL SELECT source, count(*), round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) FROM documents GROUP BY 1")
def feature_distributions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("feature"))
    total = F.sum("n").over(Window.partitionBy()) / 2
    return d.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / total, 6))
