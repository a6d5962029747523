"""Graph, vector and ranking operators over the driver's tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.functions import numeric as N
from hopweave.functions import text as X
from hopweave.operators import graph as G
from hopweave.operators import hints as H
from hopweave.operators import push as P
from hopweave.operators import ranking as R
from hopweave.plans.registry import query
from hopweave.sources.shared import keep
from hopweave.sources.tables import star_triples, table, with_ids

log = logging.getLogger(__name__)

TRIPLES = """triples AS (
  SELECT 'order ' || o_orderkey AS chunk, 'order ' || o_orderkey AS subj, 'placed by' AS pred, 'customer ' || o_custkey AS obj FROM orders
  UNION ALL SELECT 'order ' || l_orderkey, 'order ' || l_orderkey, 'contains', 'part ' || l_partkey FROM lineitem
  UNION ALL SELECT 'order ' || l_orderkey, 'part ' || l_partkey, 'supplied by', 'supplier ' || l_suppkey FROM lineitem
  UNION ALL SELECT 'order ' || o_orderkey, 'customer ' || o_custkey, 'lives in', lower(n_name) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
BRIDGE = TRIPLES + """, bridge AS (SELECT DISTINCT chunk, subj AS entity FROM triples UNION SELECT DISTINCT chunk, obj FROM triples)"""
FACTS = BRIDGE + """, facts AS MATERIALIZED (SELECT src, dst, count(*)::BIGINT AS weight FROM (SELECT subj AS src, obj AS dst FROM triples WHERE subj <> obj UNION ALL SELECT obj, subj FROM triples WHERE subj <> obj) GROUP BY ALL)"""
IDF = FACTS + """, idf AS (SELECT entity, count(*)::BIGINT AS df, ln(((SELECT count(DISTINCT chunk) FROM triples) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM bridge GROUP BY entity)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_HUNDREDTH = " WHERE a.vec_id % 100 = 0"
COS = f"""cosines AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({DOT.format(a='a.embedding', b='b.embedding')} / sqrt({DOT.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT.format(a='b.embedding', b='b.embedding')}), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{_HUNDREDTH})"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


@query(f"WITH {TRIPLES} SELECT DISTINCT 'chunk-' || md5(chunk) AS chunk_id, 'entity-' || md5(subj) AS subj_id, pred, 'entity-' || md5(obj) AS obj_id FROM triples")
def hash_ids(spark, sf_dir):
    # Names are shorter than their hashes: equal triples fall together before they are hashed.
    return with_ids(star_triples(spark, sf_dir).distinct()).select("chunk_id", "subj_id", "pred", "obj_id")


@query(f"WITH {FACTS} SELECT src, dst, weight FROM facts")
def fact_edges(spark, sf_dir):
    return G.fact_edges(star_triples(spark, sf_dir))


@query(f"WITH {BRIDGE} SELECT chunk AS src, entity AS dst, 1.0::DOUBLE AS weight FROM bridge")
def passage_edges(spark, sf_dir):
    return G.passage_edges(star_triples(spark, sf_dir))


@query(f"WITH {IDF} SELECT entity, df, round(idf, 6) AS idf FROM idf")
def entity_idf(spark, sf_dir):
    return G.entity_idf(star_triples(spark, sf_dir)).select("entity", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TRIPLES} SELECT subj, pred, obj, count(DISTINCT chunk)::BIGINT AS n_chunks FROM triples GROUP BY ALL")
def fact_documents(spark, sf_dir):
    return G.fact_documents(star_triples(spark, sf_dir))


@query(f"WITH {BRIDGE}, e AS (SELECT entity, count(*) AS n FROM bridge GROUP BY 1) SELECT count(*)::BIGINT AS entities, sum(n)::BIGINT AS passage_edges, round(avg(length(entity)), 6) AS avg_entity_chars, max(n)::BIGINT AS max_chunks FROM e")
def graph_info(spark, sf_dir):
    return G.graph_info(star_triples(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT chunk, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT DISTINCT chunk, subj || '|' || pred || '|' || obj AS line FROM triples) GROUP BY chunk")
def digest_chunks(spark, sf_dir):
    return G.digests(star_triples(spark, sf_dir))


@query(
    f"""WITH {IDF}, pairs AS (SELECT DISTINCT src, dst FROM facts), deg AS (SELECT src AS dst, count(*) AS degree FROM pairs GROUP BY 1),
    s AS (SELECT src, p.dst, round(idf / (1 + degree), 6) AS score FROM pairs p JOIN deg USING (dst) JOIN idf ON idf.entity = p.dst)
    SELECT src, dst, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s) WHERE rank <= 32"""
)
def bridge_neighbours(spark, sf_dir):
    return G.bridge_neighbours(star_triples(spark, sf_dir))


@query(f"WITH {COS} SELECT src, dst, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM cosines) WHERE rank <= 10")
def knn_embeddings(spark, sf_dir):
    return G.knn(table(spark, sf_dir, "embeddings"), 10, queries=asked(spark, sf_dir))


@query(f"WITH {COS.replace(_HUNDREDTH, '')} SELECT src, dst, score AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM cosines WHERE score >= 0.3) WHERE rank <= 101")
def synonym_edges(spark, sf_dir):
    """Every vector asks. No pair of the driver's vectors reaches the operator's own threshold of 0.8 (FIXTURES.md), so it
    is lowered here."""
    return G.synonym_edges(table(spark, sf_dir, "embeddings"), 0.3)


DENSE = f"""dense AS (SELECT query_id, vec_id, raw, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, p.vec_id, round({DOT.format(a='q.embedding', b='p.embedding')}, 6) AS raw FROM embeddings q CROSS JOIN embeddings p WHERE q.vec_id % 100 = 0) WINDOW w AS (PARTITION BY query_id))"""


def _dense(spark, sf_dir, top=None):
    return G.dense_scores(asked(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding"), table(spark, sf_dir, "embeddings"), top)


@query(f"WITH {DENSE} SELECT query_id, vec_id, raw, round(score, 6) AS score, rank::INT AS rank FROM dense WHERE rank <= 200")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 200).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {DENSE}, s AS (SELECT query_id, vec_id, exp((raw - max(raw) OVER w) / 0.7) AS e, rank, score FROM dense WHERE rank <= 64 WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, vec_id, round(e / (sum(e) OVER (PARTITION BY query_id) + 1e-12), 6) AS prob, round(0.75 * 10 / (10 + rank) + 0.25 * CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END, 6) AS prior FROM s"""
)
def softmax_seeds(spark, sf_dir):
    top = _dense(spark, sf_dir, 64)
    return top.select("query_id", "vec_id", F.round(N.softmax(F.col("raw"), "query_id", temperature=0.7), 6).alias("prob"), F.round(N.local_rank(F.col("score"), "vec_id", "query_id"), 6).alias("prior"))


_TRACK = "SELECT query_id, vec_id AS passage, raw AS score FROM dense WHERE rank <= {k}"
_LABELS = "SELECT d.query_id, d.vec_id AS passage, (CASE WHEN p.label = q.label THEN 1.0 ELSE 0.0 END + (d.vec_id % 7) / 7.0)::DOUBLE AS score FROM dense d JOIN embeddings p ON p.vec_id = d.vec_id JOIN embeddings q ON q.vec_id = d.query_id WHERE d.rank <= 100"
_MM = "(CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1.0 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END)"


def _tracks(spark, sf_dir):
    ranked = _dense(spark, sf_dir, 200)
    v = table(spark, sf_dir, "embeddings")
    base = ranked.where("rank <= 200").select("query_id", F.col("vec_id").alias("passage"), F.col("raw").alias("score"))
    labels = ranked.where("rank <= 100").join(v.select("vec_id", "label"), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    static = labels.select("query_id", F.col("vec_id").alias("passage"), ((F.col("label") == F.col("q_label")).cast("double") + (F.col("vec_id") % 7) / 7.0).alias("score"))
    return base, static, base.where("score >= 0.1")


@query(f"WITH {DENSE}, a AS ({_TRACK.format(k=200)}), b AS ({_LABELS}) SELECT query_id, passage, round(sum(s), 6) AS score FROM (SELECT query_id, passage, 0.7 * {_MM} AS s FROM a UNION ALL SELECT query_id, passage, 0.3 * {_MM} FROM b) GROUP BY ALL")
def two_way_fusion(spark, sf_dir):
    base, static, _ = _tracks(spark, sf_dir)
    return R.fuse([(base, 0.7), (static, 0.3)])


@query(
    f"""WITH {DENSE}, a AS ({_TRACK.format(k=200)}), b AS ({_LABELS}), c AS (SELECT * FROM a WHERE score >= 0.1)
    SELECT query_id, passage, round(sum(s), 6) AS score FROM (SELECT query_id, passage, 0.4 * {_MM} AS s FROM a UNION ALL SELECT query_id, passage, 0.2 * {_MM} FROM b UNION ALL SELECT query_id, passage, 0.4 * {_MM} FROM c) GROUP BY ALL"""
)
def three_way_fusion(spark, sf_dir):
    base, static, path = _tracks(spark, sf_dir)
    return R.fuse([(base, 0.4), (static, 0.2), (path, 0.4)])


@query(f"WITH {DENSE}, a AS ({_TRACK.format(k=200)}), m AS (SELECT query_id, passage, score AS raw, {_MM} AS b FROM a) SELECT query_id, passage, round(CASE WHEN raw >= 0.1 THEN 0.7 * b + 0.3 * 0.5 ELSE b END, 6) AS score FROM m")
def path_write_back(spark, sf_dir):
    base, _, path = _tracks(spark, sf_dir)
    return R.write_back(base, path.withColumn("score", F.lit(0.5)))


@query(f"WITH {DENSE}, a AS ({_TRACK.format(k=200)}), m AS (SELECT query_id, passage, score, {_MM} AS b FROM a) SELECT query_id, passage, round(score * (1 + least(0.2, 0.25 * CASE WHEN score >= 0.1 THEN 0.8 ELSE 0 END * (0.5 + 0.5 * b))), 6) AS score FROM m")
def consensus_boost(spark, sf_dir):
    base, _, path = _tracks(spark, sf_dir)
    return R.consensus_boost(base, path.select("query_id", "passage", F.lit(0.8).alias("consensus")))


# Personalised PageRank over facts and passages; a query for each nation, from the nation's own node.
# What is left unplaced after so many steps is below 0.5 ** 24 = 6e-8 of a query's mass, under the rounding to six places.
SETTLED = 24


def _pagerank_sql(steps: int) -> str:
    parts = [
        BRIDGE,
        "moves0 AS (SELECT src, dst, sum(w) AS w FROM (SELECT subj AS src, obj AS dst, 2.0 AS w FROM triples WHERE subj <> obj UNION ALL SELECT obj, subj, 2.0 FROM triples WHERE subj <> obj UNION ALL SELECT 'p ' || chunk, entity, 1.0 FROM bridge UNION ALL SELECT entity, 'p ' || chunk, 1.0 FROM bridge) GROUP BY ALL)",
        "moves AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM moves0)",
        "x0 AS (SELECT n_nationkey::BIGINT AS query_id, lower(n_name) AS node, 1.0::DOUBLE AS x FROM nation)",
    ]
    for k in range(1, steps + 1):
        parts.append(f"x{k} AS (SELECT query_id, node, sum(m) AS x FROM (SELECT query_id, dst AS node, 0.5 * x * p AS m FROM x{k - 1} JOIN moves ON node = src UNION ALL SELECT query_id, node, 0.5 * x FROM x0) GROUP BY ALL)")
    lost = f"SELECT x.query_id, x.node, x.x + coalesce(r.x, 0) * (1 - sum(x.x) OVER (PARTITION BY x.query_id)) AS score FROM x{steps} x LEFT JOIN x0 r ON r.query_id = x.query_id AND r.node = x.node"
    return f"WITH {', '.join(parts)}, s AS ({lost}) SELECT query_id, node, score, rank::INT AS rank FROM (SELECT query_id, node, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS rank FROM s WHERE node LIKE 'p %') WHERE rank <= 10"


# Residuals up to so much of a node's strength stay where they are: scores of passages (strength below 100) are then right
# to 1e-8 and better, a hundredth of their rounding.
EPS = 1e-10


@query(_pagerank_sql(SETTLED))
def ppr_topk(spark, sf_dir):
    """The ten passages (orders) nearest to each nation by personalised PageRank: the flagship query."""
    return pushed_passages(spark, sf_dir, EPS, lambda rounds: log.info("ppr_topk: nodes pushed by round %s", [r["frontier"] for r in rounds]))


def pushed_passages(spark, sf_dir, eps, report=None):
    t = star_triples(spark, sf_dir)
    passages = G.passage_edges(t).withColumn("src", F.concat(F.lit("p "), "src"))
    # A fact's edge counts for both of its directions, as fact_edges has it.
    edges = t.where("subj <> obj").select(F.col("subj").alias("src"), F.col("obj").alias("dst"), F.lit(2.0).alias("weight")).unionByName(passages)
    labels = t.select(F.explode(F.array("subj", "obj", F.concat(F.lit("p "), "chunk"))).alias("label"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lower("n_name").alias("label"), F.lit(1.0).alias("weight"))
    ids = [r.query_id for r in nations.select("query_id").orderBy("query_id").collect()]  # the query set
    with P.graph_of(edges, keep, labels) as graph:
        scores = P.push(graph, P.widen(graph.of(nations).where("node IS NOT NULL"), ids), ids, 0.5, eps, keep, report)
        named = scores.join(graph.names.where(F.col("label").startswith("p ")), "node")
        rows = P.rows_of(named, ids, "long", "label").select("query_id", F.col("label").alias("node"), F.round("score", 6).alias("score"))
        return keep(R.top_k(rows, 10, "query_id", "score", "node"))


def nearest_passages(spark, sf_dir, steps, report=None):
    t = star_triples(spark, sf_dir)
    passages = G.passage_edges(t).withColumn("src", F.concat(F.lit("p "), "src"))
    edges = G.fact_edges(t).withColumn("weight", F.col("weight").cast("double")).unionByName(passages)
    # The iteration runs on short names of nodes; only ranked passages get their labels back.
    short = edges.select(G.node_key(F.col("src")).alias("src"), G.node_key(F.col("dst")).alias("dst"), "weight")
    reset = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), G.node_key(F.lower("n_name")).alias("node"), F.lit(1.0).alias("weight"))
    names = passages.select(F.col("src").alias("label")).distinct().select(G.node_key(F.col("label")).alias("node"), "label")
    scores = G.personalised_pagerank(short, reset, 0.5, steps, keep, report)
    ranked = scores.join(names, "node").select("query_id", F.col("label").alias("node"), F.round("score", 6).alias("score"))
    return R.top_k(ranked, 10, "query_id", "score", "node")


SEEDS = IDF + """, deg AS (SELECT src AS entity, count(DISTINCT dst) AS degree FROM facts GROUP BY 1),
  seeds AS (SELECT c_nationkey::BIGINT AS query_id, 'customer ' || c_custkey AS entity, c_acctbal / 10000.0 AS sim, idf, degree FROM customer JOIN idf ON entity = 'customer ' || c_custkey JOIN deg USING (entity) WHERE c_mktsegment = 'BUILDING'),
  probs AS (SELECT query_id, entity, exp((raw - max(raw) OVER w) / 0.7) / (sum(exp((raw - mx) / 0.7)) OVER w + 1e-12) AS prob FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS mx FROM (SELECT query_id, entity, sim * idf / pow(1 + degree, 0.35) AS raw FROM seeds)) WINDOW w AS (PARTITION BY query_id))"""


# Seeds are customers and bridges are orders, so entities of other kinds need not be exchanged.
_CUSTOMER = lambda c: c.startswith("customer ")
_ORDER = lambda c: c.startswith("order ")
_ON_PATHS = lambda c: _CUSTOMER(c) | _ORDER(c)


def _seeds(spark, sf_dir):
    t = star_triples(spark, sf_dir)
    own = t.where(_CUSTOMER(F.col("subj")) | _CUSTOMER(F.col("obj")))
    degree = G.fact_edges(own).where(_CUSTOMER(F.col("src"))).groupBy(F.col("src").alias("entity")).agg(F.count(F.lit(1)).alias("degree"))
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").cast("long").alias("query_id"), F.concat(F.lit("customer "), F.col("c_custkey")).alias("entity"), (F.col("c_acctbal") / 10000.0).alias("sim"))
    return R.seed_distribution(c.join(G.entity_idf(t, _CUSTOMER), "entity").join(degree, "entity"))


@query(f"WITH {SEEDS} SELECT query_id, entity, round(prob, 6) AS prob FROM probs")
def seed_distribution(spark, sf_dir):
    return _seeds(spark, sf_dir).select("query_id", "entity", F.round("prob", 6).alias("prob"))


PATHS = SEEDS + """, s AS (SELECT query_id, entity, prob, count(*) OVER (PARTITION BY query_id) AS n FROM probs),
  hops AS (SELECT DISTINCT src, dst, idf FROM facts JOIN idf ON entity = dst WHERE src LIKE 'customer %' AND dst LIKE 'order %'),
  paths AS (SELECT query_id, [s.entity] AS nodes, chunk AS passage, prob AS rel, 1.0 AS conn, prob AS cons, 1.0 / n AS comp FROM s JOIN bridge USING (entity)
    UNION ALL SELECT query_id, [src, dst], chunk, prob, 1.2, 0.5 * prob + 0.5 * idf, 1.0 / n FROM s JOIN hops ON s.entity = src JOIN bridge b ON b.entity = dst),
  scored AS (SELECT query_id, nodes, passage, round(0.55 * mm(rel, min(rel) OVER w, max(rel) OVER w) + 0.15 * mm(conn, min(conn) OVER w, max(conn) OVER w) + 0.15 * mm(cons, min(cons) OVER w, max(cons) OVER w) + 0.15 * mm(comp, min(comp) OVER w, max(comp) OVER w), 6) AS total FROM paths WINDOW w AS (PARTITION BY query_id))"""
for _c in ("rel", "conn", "cons", "comp"):
    PATHS = PATHS.replace(f"mm({_c}, min({_c}) OVER w, max({_c}) OVER w)", f"CASE WHEN max({_c}) OVER w - min({_c}) OVER w <= 1e-8 THEN 1.0 ELSE ({_c} - min({_c}) OVER w) / (max({_c}) OVER w - min({_c}) OVER w) END")


def _paths(spark, sf_dir):
    t = star_triples(spark, sf_dir)
    idf = G.entity_idf(t, _ORDER)
    hops = G.fact_edges(t.where(_ON_PATHS(F.col("subj")) & _ON_PATHS(F.col("obj")))).where("src LIKE 'customer %' AND dst LIKE 'order %'").join(idf.select(F.col("entity").alias("dst"), "idf"), "dst").select("src", "dst", "idf")
    return R.path_scores(R.path_candidates(_seeds(spark, sf_dir).select("query_id", "entity", "prob"), G.bridge(t, _ON_PATHS), hops))


@query(f"WITH {PATHS} SELECT query_id, array_to_string(nodes, '>') AS nodes, passage, total FROM scored")
def path_candidates(spark, sf_dir):
    return _paths(spark, sf_dir).select("query_id", F.array_join("nodes", ">").alias("nodes"), "passage", "total")


@query(f"WITH {PATHS} SELECT query_id, passage, max(total) AS score FROM scored GROUP BY ALL")
def path_passage_max(spark, sf_dir):
    return R.path_passages(_paths(spark, sf_dir))


@query(
    f"""WITH {PATHS}, e AS (SELECT query_id, unnest(nodes) AS entity FROM scored), c AS (SELECT query_id, entity, count(*)::BIGINT AS n_paths FROM e GROUP BY ALL HAVING count(*) >= 2),
    x AS (SELECT query_id, entity, n_paths, round(n_paths * idf, 6) AS weight FROM c JOIN idf USING (entity) WHERE idf >= 2)
    SELECT query_id, entity, n_paths, weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, entity) AS rank FROM x) WHERE rank <= 5"""
)
def mpce_entities(spark, sf_dir):
    t = star_triples(spark, sf_dir)
    return R.consensus_entities(_paths(spark, sf_dir), G.entity_idf(t, _ON_PATHS)).select("query_id", "entity", "n_paths", "weight", "rank")


@query(
    f"""WITH {PATHS}, f AS (SELECT query_id, nodes[1] AS seed, nodes[2] AS bridge, passage, total FROM scored WHERE len(nodes) = 2),
    v AS (SELECT query_id, seed, bridge, count(DISTINCT passage)::BIGINT AS votes, max(total) AS best, round(max(0.7 * total + 0.3 * 0.5), 6) AS confidence FROM f GROUP BY ALL)
    SELECT query_id, seed, bridge, votes, best, confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY votes DESC, confidence DESC, best DESC, bridge) AS rank FROM v) WHERE rank <= 1"""
)
def hint_votes(spark, sf_dir):
    paths = _paths(spark, sf_dir).where("size(nodes) = 2")
    return R.hint_votes(paths.select("query_id", F.get("nodes", F.lit(0)).alias("seed"), F.get("nodes", F.lit(1)).alias("bridge"), "passage", F.col("total").alias("path_score"), F.lit(0.5).alias("seed_prob")))


_HINTS = PATHS + """, docs0 AS (SELECT c_nationkey::BIGINT AS query_id, 'order ' || o_orderkey AS passage, 'order ' || o_orderkey || ' was placed by customer ' || o_custkey AS text, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey),
  docs1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage) AS rank FROM docs0), docs AS MATERIALIZED (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS ps FROM docs1 WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)),
  pr AS MATERIALIZED (SELECT query_id, entity, prob FROM probs), inside AS MATERIALIZED (SELECT d.*, entity, idf FROM docs d JOIN bridge b ON b.chunk = passage LEFT JOIN idf USING (entity) WHERE query_id IN (SELECT query_id FROM pr)),
  one AS MATERIALIZED (SELECT DISTINCT query_id, f.src AS seed, f.dst AS bridge, passage, ps FROM inside i JOIN facts f ON f.dst = i.entity JOIN pr USING (query_id) WHERE pr.entity = f.src AND f.dst LIKE 'order %' AND split_part(f.src, ' ', 2)::BIGINT % 2 = 0 AND ps >= 0.1 AND contains(text, i.entity)),
  rare AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, passage ORDER BY coalesce(idf, 1.0) DESC, entity) AS n FROM inside i WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.query_id = i.query_id AND pr.entity = i.entity)) WHERE n <= 3),
  held AS MATERIALIZED (SELECT query_id, passage, rank, entity AS seed FROM inside JOIN pr USING (query_id, entity)),
  two AS MATERIALIZED (SELECT r.query_id, seed, entity AS bridge, r.passage, ps FROM rare r JOIN held h ON h.query_id = r.query_id AND h.passage = r.passage WHERE ps >= 0.1 AND contains(text, entity) AND r.query_id NOT IN (SELECT query_id FROM one)),
  own AS (SELECT query_id, seed FROM held WHERE rank = 1 UNION ALL SELECT query_id, min(entity) FROM pr WHERE query_id NOT IN (SELECT query_id FROM held WHERE rank = 1) GROUP BY 1),
  three AS (SELECT r.query_id, seed, entity AS bridge, passage, ps FROM rare r JOIN own USING (query_id) WHERE rank = 1 AND r.query_id NOT IN (SELECT query_id FROM one UNION ALL SELECT query_id FROM two)),
  cand AS MATERIALIZED (SELECT c.*, coalesce(prob, 0.0) AS prob FROM (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) c LEFT JOIN pr ON pr.query_id = c.query_id AND pr.entity = c.seed),
  voted AS MATERIALIZED (SELECT query_id, seed, c.bridge, min(tier) AS tier, count(*) AS votes, max(ps) AS best, round(max(0.7 * ps + 0.3 * prob), 6) AS confidence, count(DISTINCT passage) AS n_passages FROM cand c GROUP BY ALL),
  rivals AS (SELECT query_id, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS conflict FROM (SELECT query_id, seed, count(*) AS n FROM voted GROUP BY ALL) GROUP BY 1),
  kept AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY query_id, seed ORDER BY votes DESC, confidence DESC, best DESC, coalesce(idf, 1.0) DESC, v.bridge) AS k FROM voted v LEFT JOIN idf ON idf.entity = v.bridge) WHERE k = 1)"""


@query(f"WITH {_HINTS} SELECT query_id, seed, bridge, tier::INT AS tier, votes::BIGINT AS votes, confidence, n_passages::INT AS n_passages, conflict, hint_id::INT AS hint_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, votes DESC, seed, bridge) - 1 AS hint_id FROM kept) JOIN rivals USING (query_id) WHERE hint_id < 10")
def path_hints(spark, sf_dir):
    """Hints of each nation: its ten dearest orders as passages, customers of one segment as seeds, orders next to every
    second of them as bridges."""
    t = star_triples(spark, sf_dir)
    idf = keep(G.entity_idf(t))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    docs = orders.select(F.col("c_nationkey").cast("long").alias("query_id"), F.concat(F.lit("order "), "o_orderkey").alias("passage"), F.col("o_totalprice").alias("score"))
    texts = orders.select(F.concat(F.lit("order "), "o_orderkey").alias("passage"), F.concat(F.lit("order "), "o_orderkey", F.lit(" was placed by customer "), "o_custkey").alias("text"))
    seeds = keep(_seeds(spark, sf_dir).select("query_id", F.col("entity").alias("seed"), "prob"))
    even = F.split_part("src", F.lit(" "), F.lit(2)).cast("long") % 2 == 0
    near = G.fact_edges(t.where(_ON_PATHS(F.col("subj")) & _ON_PATHS(F.col("obj")))).where(F.col("src").startswith("customer ") & F.col("dst").startswith("order ")).where(even).select(F.col("src").alias("seed"), F.col("dst").alias("bridge"))
    found = keep(H.candidates(R.top_k(docs, 10, "query_id", "score", "passage"), seeds, seeds.join(near, "seed").select("query_id", "seed", "bridge"), G.bridge(t).select(F.col("chunk").alias("passage"), "entity"), idf, texts, keep, pool=3))
    return H.hints(found, idf).select("query_id", "seed", "bridge", "tier", "votes", "confidence", F.size("passages").alias("n_passages"), "conflict", "hint_id")


@query(f"WITH {IDF}, s AS (SELECT o_orderpriority AS q, 'customer ' || o_custkey AS entity, o_totalprice / 1e6 AS fact_score FROM orders), w AS (SELECT q, entity, round(avg(fact_score / df), 6) AS weight FROM s JOIN idf USING (entity) GROUP BY ALL) SELECT q AS query_id, entity, weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, entity) AS rank FROM w) WHERE rank <= 5")
def phrase_links(spark, sf_dir):
    df = G.entity_idf(star_triples(spark, sf_dir)).select("entity", "df")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query_id"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("entity"), (F.col("o_totalprice") / 1e6).alias("fact_score"))
    return R.phrase_links(facts, df)


_GONE = "SELECT DISTINCT 'order ' || o_orderkey AS chunk FROM orders WHERE o_orderstatus = 'F'"


@query(f"WITH {BRIDGE}, gone AS ({_GONE}) SELECT DISTINCT entity FROM bridge JOIN gone USING (chunk) WHERE entity NOT IN (SELECT entity FROM bridge WHERE chunk NOT IN (SELECT chunk FROM gone))")
def orphan_entities_on_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order "), F.col("o_orderkey")).alias("chunk"))
    return G.delete_chunks(star_triples(spark, sf_dir), gone)[1]


# What must come out, said without the join that is tested: the stored edges lack some sources and one of each larger weight.
@query(f"""WITH {FACTS} SELECT src, dst, weight AS expected, CASE WHEN src LIKE 'supplier 1%' THEN NULL ELSE weight - 1 END AS actual, CASE WHEN src LIKE 'supplier 1%' THEN 'missing' ELSE 'weight' END AS issue
  FROM facts WHERE src LIKE 'supplier 1%' OR weight > 2""")
def edge_audit(spark, sf_dir):
    edges = G.fact_edges(star_triples(spark, sf_dir))
    stored = edges.where("NOT src LIKE 'supplier 1%'").withColumn("weight", F.when(F.col("weight") > 2, F.col("weight") - 1).otherwise(F.col("weight")))
    return G.edge_audit(edges, stored)


@query(f"WITH {FACTS} SELECT src, dst, weight FROM facts WHERE src LIKE 'customer%' AND dst LIKE 'order%' OR src LIKE 'order%' AND dst LIKE 'customer%'")
def known_endpoints(spark, sf_dir):
    t = star_triples(spark, sf_dir)
    nodes = G.bridge(t).where("entity LIKE 'customer%' OR entity LIKE 'order%'").select(F.col("entity").alias("node"))
    return G.known_endpoints(G.fact_edges(t), nodes)


@query(f"SELECT count(*)::BIGINT AS n, count(DISTINCT vec_id)::BIGINT AS n_ids, count(*) FILTER (len(embedding) <> 64)::BIGINT AS bad_dimension, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0)::BIGINT AS not_finite, count(*) FILTER (abs(sqrt({DOT.format(a='embedding', b='embedding')}) - 1) > 0.02)::BIGINT AS bad_norm FROM embeddings")
def vector_audit(spark, sf_dir):
    return G.vector_audit(table(spark, sf_dir, "embeddings"), 64)


@query("SELECT DISTINCT 'entity-' || md5(lower(p_name || ' ' || p_partkey)) AS hash_id FROM part WHERE 'entity-' || md5(lower(p_name || ' ' || p_partkey)) NOT IN (SELECT 'entity-' || md5(lower(p_name || ' ' || p_partkey)) FROM part WHERE p_size < 25)")
def missing_anti_join(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select("p_size", X.hash_id("entity", F.lower(F.concat("p_name", F.lit(" "), "p_partkey"))).alias("hash_id"))
    return G.missing_ids(ids.select("hash_id"), ids.where("p_size < 25"))


@query("SELECT p_partkey, 'entity-' || md5(lower(p_name)) AS hash_id FROM part WHERE 'entity-' || md5(lower(p_name)) IN (SELECT 'entity-' || md5(lower(p_name)) FROM part WHERE p_size < 25)")
def prune_store(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select("p_partkey", "p_size", X.hash_id("entity", F.lower("p_name")).alias("hash_id"))
    return G.prune(ids.select("p_partkey", "hash_id"), ids.where("p_size < 25"))


@query(f"WITH {FACTS} SELECT src, dst, CASE WHEN src LIKE 'customer 1%' THEN 0.5 ELSE weight END::DOUBLE AS weight FROM facts")
def synonym_overwrite(spark, sf_dir):
    t = star_triples(spark, sf_dir)
    own = lambda c: c.startswith("customer 1")
    synonyms = G.fact_edges(t.where(own(F.col("subj")) | own(F.col("obj")))).where(own(F.col("src"))).withColumn("weight", F.lit(0.5))
    return G.merge_edges(G.fact_edges(t), synonyms)


@query("SELECT c_nationkey::BIGINT AS query_id, 'c' || c_custkey AS beam_id, binding, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, 'c' || c_custkey) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, binding ORDER BY score DESC, 'c' || c_custkey) AS f FROM (SELECT *, c_mktsegment AS binding, round(c_acctbal / 10000, 6) AS score FROM customer)) WHERE f = 1) WHERE rank <= 3")
def beam_pruning(spark, sf_dir):
    beams = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("beam_id"), F.col("c_mktsegment").alias("binding"), F.round(F.col("c_acctbal") / 10000, 6).alias("score"))
    return R.prune_beams(beams)


@query("SELECT query_id, passage, base, goal_score, verified, best, class::INT AS class, utility, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY class, utility DESC, passage) AS rank FROM (SELECT *, CASE WHEN verified THEN 0 WHEN best THEN 1 ELSE 2 END AS class, round(0.4 * base + 0.6 * goal_score, 6) AS utility FROM (SELECT query_id, passage, max(base) AS base, max(goal_score) AS goal_score, bool_or(verified) AS verified, bool_or(best) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id, goal ORDER BY goal_score DESC, passage) = 1 AS best FROM (SELECT l_suppkey AS query_id, l_partkey AS passage, l_discount AS base, l_returnflag AS goal, l_tax AS goal_score, l_linestatus = 'F' AND l_quantity > 48 AS verified FROM lineitem)) GROUP BY query_id, passage))) WHERE rank <= 80")
def trim_pool(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("passage"), F.col("l_discount").alias("base"), F.col("l_returnflag").alias("goal"), F.col("l_tax").alias("goal_score"), F.expr("l_linestatus = 'F' AND l_quantity > 48").alias("verified"))
    return R.trim_pool(lines)


@query("SELECT query_id, passage, round(sum(1.0 / (1 + rank) / n), 6) AS weight FROM (SELECT *, count(DISTINCT sub_question) OVER (PARTITION BY query_id) AS n FROM (SELECT l_suppkey AS query_id, l_returnflag AS sub_question, l_partkey AS passage, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) - 1 AS rank FROM lineitem)) GROUP BY ALL")
def anchor_weights(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey")) - 1
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_returnflag").alias("sub_question"), F.col("l_partkey").alias("passage"), rank.alias("rank"))
    return R.anchor_weights(ranked)
