"""Extraction, reading, evidence and experiment operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.functions import text as X
from hopweave.operators import extraction as E, ranking as R, retrieval as S, selection as L, trials as T
from hopweave.plans.registry import query
from hopweave.sources import stores
from hopweave.sources.tables import star_triples, table

_TURN = "CASE turn % 4 WHEN 0 THEN '{\"answer\": \"' || role || turn || '\"}' WHEN 1 THEN 'Thought: x.' || chr(10) || 'Final answer: ' || role || ' ' || turn || chr(10) || 'end' WHEN 2 THEN 'one' || chr(10) || role || turn || chr(10) || ' ' ELSE '' END"


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN role || ' ' || turn WHEN 3 THEN '' ELSE role || turn END AS answer FROM conversations")
def answer_extraction(spark, sf_dir):
    """Responses in each form an answer comes in; the SQL knows the answer from how the response was made."""
    c = table(spark, sf_dir, "conversations").withColumn("response", F.expr(_TURN.replace("chr(10)", "'\\n'")))
    return c.select("conv_id", "turn", E.answer_of(F.col("response")).alias("answer"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^\s0-9A-Za-z_]'))::INT AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", E.n_tokens(F.col("text")).alias("n_tokens"))


@query("SELECT DISTINCT 'order ' || o_orderkey AS chunk, 'order ' || o_orderkey AS subj, 'placed by' AS pred, 'customer ' || o_custkey AS obj FROM orders")
def graph_triples(spark, sf_dir):
    """Raw lists with a repeated triple, one of two parts and one whose object is no word."""
    t = star_triples(spark, sf_dir).where("pred = 'placed by'")
    raw = F.array(F.array(F.initcap("subj"), F.lit(" Placed by "), "obj"), F.array("subj", "pred"), F.array(F.initcap("subj"), F.lit(" Placed by "), "obj"), F.array("subj", "pred", F.lit(" -- ")))
    return E.graph_triples(t.select("chunk", raw.alias("triples")))


@query("SELECT p_partkey, contains(lower(p_name), lower(substr(p_name, 3, 4))) AS by_part, contains(lower(p_name), p_partkey::VARCHAR || ' zz') AS by_number FROM part")
def entity_support(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", E.entity_supported(F.expr("substr(p_name, 3, 4)"), F.col("p_name")).alias("by_part"), E.entity_supported(F.concat(F.col("p_partkey").cast("string"), F.lit(" zz")), F.col("p_name")).alias("by_number"))


@query("SELECT query_id, passage, goal, max(score) AS score FROM (SELECT l_orderkey AS query_id, l_partkey AS passage, l_returnflag AS goal, l_discount AS score FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_partkey, l_returnflag, l_tax FROM lineitem WHERE l_quantity > 25) GROUP BY ALL")
def goal_coverage(spark, sf_dir):
    """Routes ask for a line status; every order is bound to F."""
    lines = table(spark, sf_dir, "lineitem")
    base = [F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("passage"), F.col("l_returnflag").alias("goal")]
    routes = lines.select(*base, F.col("l_discount").alias("score"), F.create_map(F.lit("s1"), "l_linestatus").alias("requirements"))
    proofs = lines.where("l_quantity > 25").select(*base, F.col("l_tax").alias("score"))
    bindings = lines.select(F.col("l_orderkey").alias("query_id")).distinct().withColumn("bound", F.create_map(F.lit("s1"), F.lit("f")))
    return L.goal_coverage(routes, proofs, bindings)


@query("WITH p AS (SELECT quality::BIGINT AS x, toxic::BIGINT AS y FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (x = y) AS agreed FROM p), c AS (SELECT sum(a.c * b.c)::DOUBLE AS s FROM (SELECT x AS v, count(*) AS c FROM p GROUP BY 1) a JOIN (SELECT y AS v, count(*) AS c FROM p GROUP BY 1) b USING (v)) SELECT n::BIGINT AS n, agreed::BIGINT AS agreed, round((agreed / n - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, c")
def label_agreement(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return T.label_agreement(labels.select("doc_id", F.col("quality").alias("label")), labels.select("doc_id", F.col("toxic").alias("label")), "doc_id", "label")


@query("WITH m AS (SELECT o_orderpriority AS \"case\", (o_custkey % 3)::BIGINT AS hops, count(*)::BIGINT AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS recomputed FROM orders GROUP BY ALL) SELECT \"case\", hops, n, recomputed, CASE WHEN hops = 1 THEN recomputed + 0.01 ELSE recomputed END AS published, hops <> 1 AS agrees FROM m")
def recomputed_cases(spark, sf_dir):
    """Published values that are right, but for those of hop 1."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("case"), (F.col("o_custkey") % 3).cast("long").alias("hops"), (F.col("o_orderstatus") == "F").cast("double").alias("recall"))
    right = rows.groupBy("case", "hops").agg(F.round(F.avg("recall"), 4).alias("value"))
    return T.recompute(rows, right.withColumn("value", F.when(F.col("hops") == 1, F.col("value") + 0.01).otherwise(F.col("value"))))


@query("SELECT o_orderpriority AS mechanism, count(*)::BIGINT AS swaps, count(*) FILTER (o_custkey % 5 > o_custkey % 3)::BIGINT AS helped, count(*) FILTER (o_custkey % 5 < o_custkey % 3)::BIGINT AS hurt, round(sum((o_custkey % 5 - o_custkey % 3)::DOUBLE), 6) AS net FROM orders GROUP BY 1")
def swap_attribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "query_id")
    recall = lambda k: o.select("query_id", (F.col("o_custkey") % k).cast("double").alias("recall"))
    return T.attribute_swaps(o.select("query_id", F.col("o_orderpriority").alias("mechanism")), recall(3), recall(5))


@query("SELECT o_orderkey::VARCHAR AS idx FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")
def pending_extractions(spark, sf_dir):
    """Open orders have no row, urgent ones a failed one, high ones one of another contract."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderpriority").startswith("1"), "failed").otherwise("success")
    stored = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("idx"), status.alias("status"), F.when(F.col("o_orderpriority").startswith("2"), "old").otherwise("now").alias("contract"))
    return stores.pending(o.select(F.col("o_orderkey").cast("string").alias("idx")), stored, "now")


@query("SELECT idx, reason FROM (SELECT o_orderkey::VARCHAR AS idx, CASE WHEN o_custkey % 5 = 0 THEN 'other_contract' WHEN o_custkey % 5 = 1 THEN 'unknown_chunk' WHEN o_custkey % 5 = 2 THEN 'changed_passage' WHEN o_custkey % 5 = 3 AND o_orderstatus = 'F' THEN 'worse_than_base' END AS reason FROM orders) WHERE reason IS NOT NULL")
def overlay_rejections(spark, sf_dir):
    """A checkpoint with rows of each fault: by customer another contract, no chunk, another passage, failed over a good row."""
    o = table(spark, sf_dir, "orders").withColumn("idx", F.col("o_orderkey").cast("string")).withColumn("k", F.col("o_custkey") % 5)
    row = lambda passage, status, contract: o.select("idx", passage.alias("passage"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<array<string>>").alias("triples"), status.alias("status"), contract.alias("contract"), "k")
    base = row(F.col("o_comment") if "o_comment" in o.columns else F.col("idx"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed"), F.lit("now"))
    done = row(F.when(F.col("k") == 2, "other").otherwise(F.col("idx")), F.when(F.col("k") == 3, "failed").otherwise("success"), F.when(F.col("k") == 0, "old").otherwise("now")).drop("k")
    chunks = o.where("k <> 1").select("idx", F.col("idx").alias("passage"))
    return stores.overlay(base.drop("k"), done, "now", chunks)[1]


@query("SELECT l_orderkey::VARCHAR AS idx, l_linenumber AS ordinal, (floor(coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 40))::INT AS batch FROM (SELECT min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, l_orderkey, l_linenumber, length('part ' || min(l_partkey) || ' by ' || min(l_suppkey)) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def audit_batches(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rows = lines.select(F.col("l_orderkey").cast("string").alias("idx"), F.col("l_linenumber").alias("ordinal"), F.format_string("part %s by %s", F.col("p").cast("string"), F.col("s").cast("string")).alias("prompt"))
    return E.audit_batches(rows, 40).select("idx", "ordinal", "batch")


@query("SELECT query_id, entity, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM (SELECT c_nationkey::BIGINT AS query_id, 'c' || c_custkey AS entity, round(c_acctbal / 10000 * (1 + c_custkey % 7), 6) AS score FROM customer)) WHERE rank <= 5")
def stable_seeds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), (F.col("c_acctbal") / 10000).alias("sim"), (1 + F.col("c_custkey") % 7).alias("idf"))
    return S.top_seeds(c).select("query_id", "entity", "score", "rank")


@query("SELECT c_custkey, round(b / t, 6) AS base, round(0.2 / t, 6) AS static, round(p / t, 6) AS path FROM (SELECT *, b + 0.2 + p AS t FROM (SELECT c_custkey, 0.4 * greatest(0.05, 1 - 0.25 * s) AS b, 0.4 * (1 + 0.5 * s) AS p FROM (SELECT c_custkey, 0.5 * least(1.0, (c_custkey % 6) / 3.0) + 0.5 * (c_nationkey / 25.0) AS s FROM customer)))")
def adaptive_weights(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base, static, path = R.adaptive_weights(F.col("c_custkey") % 6, F.col("c_nationkey") / 25.0)
    return c.select("c_custkey", F.round(base, 6).alias("base"), F.round(static, 6).alias("static"), F.round(path, 6).alias("path"))


_WORDS = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g')), ' '), lambda x: x <> '')"


@query(
    f"""WITH q AS (SELECT s_suppkey::BIGINT AS query_id, {_WORDS.format("'maker ' || lower(n_name) || ' of part ' || s_suppkey")} AS tokens FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    e AS (SELECT lower(n_name) AS entity, {_WORDS.format('n_name')} AS own, 2.0 AS idf FROM nation UNION ALL SELECT 'part ' || p_partkey, ['part', p_partkey::VARCHAR], 1.5 FROM part),
    p AS (SELECT query_id, entity, idf, contains(array_to_string(tokens, ' '), array_to_string(own, ' '))::INT::DOUBLE AS whole, contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || array_to_string(own, ' ') || ' ')::INT::DOUBLE AS gram, len(list_intersect(tokens, own)) / len(list_distinct(list_concat(tokens, own))) AS shared FROM q JOIN e ON len(list_intersect(tokens, own)) > 0),
    s AS (SELECT query_id, entity, round((1.5 * whole + gram + 1.5 * shared) * idf, 6) AS score FROM p)
    SELECT query_id, entity, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM s WHERE score >= 0.15) WHERE rank <= 32"""
)
def weak_seeds(spark, sf_dir):
    words = lambda c: X.tokens(X.surface_norm(c))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    asked = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    queries = asked.select(F.col("s_suppkey").cast("long").alias("query_id"), words(F.concat(F.lit("maker "), "name", F.lit(" of part "), F.col("s_suppkey").cast("string"))).alias("tokens"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity"), F.lit(1.5).alias("idf"))
    entities = nation.select(F.col("name").alias("entity"), F.lit(2.0).alias("idf")).unionByName(parts)
    return R.weak_seeds(queries, entities.select("entity", words(F.col("entity")).alias("tokens")), entities.select("entity", "idf"))


@query("WITH r AS (SELECT l_orderkey AS query_id, passage, row_number() OVER (PARTITION BY l_orderkey ORDER BY x DESC, passage) AS rank FROM (SELECT l_orderkey, 'p' || l_partkey AS passage, max(l_extendedprice) AS x FROM lineitem GROUP BY ALL)), p AS (SELECT query_id, max(CASE WHEN rank = 2 THEN passage END) AS removed, max(CASE WHEN rank = 6 THEN passage END) AS added FROM r GROUP BY 1 HAVING max(rank) >= 2) SELECT query_id, removed, coalesce(added, 'none') AS added, CASE WHEN added IS NULL THEN 'added_outside_tail' WHEN query_id % 4 = 1 THEN 'quote_not_literal' WHEN query_id % 4 = 2 THEN 'low_confidence' WHEN query_id % 3 = 0 THEN 'removes_support' WHEN query_id % 5 = 0 THEN 'not_reviewed' WHEN query_id % 5 = 1 THEN 'reviewer_refused' END AS reason FROM p")
def swap_reviews(spark, sf_dir):
    """In each order the second part is to give way to the sixth; quotes, confidence, support and reviews fail by number."""
    from pyspark.sql import Window

    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("passage")).agg(F.max("l_extendedprice").alias("x"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x"), "passage"))).drop("x")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("passage")))
    pairs = ranked.groupBy("query_id").agg(at(2).alias("removed"), F.coalesce(at(6), F.lit("none")).alias("added")).where("removed IS NOT NULL")
    k = F.col("query_id")
    text = lambda c: F.concat(F.lit("the text of "), c)
    proposals = pairs.select("query_id", "removed", "added", F.when(k % 4 == 1, "no such words").otherwise(text(F.col("added"))).alias("quote"), F.when(k % 4 == 2, 0.5).otherwise(0.9).alias("confidence"))
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("passage")).withColumn("text", text(F.col("passage")))
    supported = pairs.where("query_id % 3 = 0").select("query_id", F.col("removed").alias("passage"))
    reviews = pairs.where("query_id % 5 <> 0").select("query_id", "removed", "added", (k % 5 != 1).alias("accepts"))
    return L.review_swaps(proposals, ranked, texts, supported, reviews)


@query()
def difficulty_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return T.difficulty_split(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority", "o_orderkey", 40)


@query()
def representative_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return T.draw(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 60)
