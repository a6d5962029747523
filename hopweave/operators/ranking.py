"""Ranking operators: fusion, paths over bridges, consensus boost, seeds. Scores per (query_id, passage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hopweave.functions.numeric import minmax, softmax
from hopweave.sources.shared import TASK_ROWS, spread


def top_k(df: DataFrame, k: int, by: str, score: str, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of min-maxed scores (query_id, passage, score); weights scaled to 1, absent scores 0.

    One union and one aggregation, whatever the number of parts: no chain of outer joins.
    """
    total = sum(w for _, w in parts)
    scaled = [df.select("query_id", "passage", (minmax(F.col("score"), "query_id") * (w / total)).alias("score")) for df, w in parts]
    union = scaled[0]
    for more in scaled[1:]:
        union = union.unionByName(more)
    return union.groupBy("query_id", "passage").agg(F.round(F.sum("score"), 6).alias("score"))


def adaptive_weights(hints: Column, replacement: Column) -> tuple[Column, Column, Column]:
    """Base, static and path weight of a query from its number of hints and its replacement rate, scaled to sum 1."""
    s = 0.5 * F.least(F.lit(1.0), hints / 3.0) + 0.5 * replacement
    base, static, path = 0.4 * F.greatest(F.lit(0.05), 1 - 0.25 * s), F.lit(0.2), 0.4 * (1 + 0.5 * s)
    return base / (base + static + path), static / (base + static + path), path / (base + static + path)


def seed_distribution(seeds: DataFrame, temperature: float = 0.7, gamma: float = 0.35) -> DataFrame:
    """seeds: query_id, entity, sim, idf, degree. Adds the softmax of sim * idf / (1 + degree) ** gamma."""
    scored = seeds.withColumn("raw", F.col("sim") * F.col("idf") / F.pow(1 + F.col("degree"), gamma))
    return scored.withColumn("prob", softmax(F.col("raw"), "query_id", temperature=temperature))


def phrase_links(facts: DataFrame, df: DataFrame, top: int = 5) -> DataFrame:
    """facts: query_id, entity, fact_score. Mean of score over document frequency, the best few of a query."""
    joined = facts.join(df, "entity").groupBy("query_id", "entity").agg(F.round(F.avg(F.col("fact_score") / F.col("df")), 6).alias("weight"))
    return top_k(joined, top, "query_id", "weight", "entity")


def path_candidates(seeds: DataFrame, bridge: DataFrame, hops: DataFrame) -> DataFrame:
    """Direct paths seed - passage, and paths seed - bridge - passage. seeds: query_id, entity, prob; hops: src, dst, idf."""
    n = Window.partitionBy("query_id")
    seeds = seeds.withColumn("n_seeds", F.count(F.lit(1)).over(n))
    direct = seeds.join(bridge, "entity").select("query_id", F.array("entity").alias("nodes"), F.col("chunk").alias("passage"), F.col("prob").alias("rel"), F.lit(1.0).alias("conn"), F.col("prob").alias("cons"), (1 / F.col("n_seeds")).alias("comp"))
    via = seeds.join(hops, seeds.entity == hops.src).join(bridge.withColumnRenamed("entity", "dst"), "dst")
    bridged = via.select("query_id", F.array("src", "dst").alias("nodes"), F.col("chunk").alias("passage"), F.col("prob").alias("rel"), F.lit(1.2).alias("conn"), (0.5 * F.col("prob") + 0.5 * F.col("idf")).alias("cons"), (1 / F.col("n_seeds")).alias("comp"))
    return direct.unionByName(bridged)


def path_scores(paths: DataFrame) -> DataFrame:
    """0.55 rel + 0.15 conn + 0.15 cons + 0.15 comp, each min-maxed within its query."""
    part = lambda c, w: w * minmax(F.col(c), "query_id", least_range=1e-8)
    return paths.withColumn("total", F.round(part("rel", 0.55) + part("conn", 0.15) + part("cons", 0.15) + part("comp", 0.15), 6))


def path_passages(paths: DataFrame) -> DataFrame:
    return paths.groupBy("query_id", "passage").agg(F.max("total").alias("score"))


def path_pool(paths: DataFrame, size: int = 80) -> DataFrame:
    """All paths of the first passages of each query, by a passage's best path: paths of one passage crowd no other out."""
    best = path_passages(paths)
    return paths.join(top_k(best, size, "query_id", "score", "passage").select("query_id", "passage"), ["query_id", "passage"], "left_semi")


def write_back(base: DataFrame, chosen: DataFrame) -> DataFrame:
    """0.7 * min-maxed base score + 0.3 * path score of chosen passages."""
    scaled = base.select("query_id", "passage", minmax(F.col("score"), "query_id").alias("b"))
    joined = scaled.join(chosen.select("query_id", "passage", F.col("score").alias("p")), ["query_id", "passage"], "left")
    return joined.select("query_id", "passage", F.round(F.when(F.col("p").isNull(), F.col("b")).otherwise(0.7 * F.col("b") + 0.3 * F.col("p")), 6).alias("score"))


def consensus_entities(paths: DataFrame, idf: DataFrame, least_paths: int = 2, least_idf: float = 2.0, top: int = 5) -> DataFrame:
    """Entities in several selected paths of a query, weighted by count * idf."""
    counted = paths.select("query_id", F.explode("nodes").alias("entity")).groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n_paths"))
    weighted = counted.where(F.col("n_paths") >= least_paths).join(idf, "entity").where(F.col("idf") >= least_idf)
    return top_k(weighted.withColumn("weight", F.round(F.col("n_paths") * F.col("idf"), 6)), top, "query_id", "weight", "entity")


def consensus_boost(base: DataFrame, support: DataFrame, gamma: float = 0.25, cap: float = 0.2) -> DataFrame:
    """score * (1 + min(cap, gamma * consensus * (0.5 + 0.5 * base))). support: query_id, passage, consensus in 0..1."""
    joined = base.withColumn("b", minmax(F.col("score"), "query_id")).join(support, ["query_id", "passage"], "left")
    lift = F.least(F.lit(cap), gamma * F.coalesce("consensus", F.lit(0.0)) * (0.5 + 0.5 * F.col("b")))
    return joined.select("query_id", "passage", F.round(F.col("score") * (1 + lift), 6).alias("score"))


def hint_votes(candidates: DataFrame, per_seed: int = 1) -> DataFrame:
    """candidates: query_id, seed, bridge, passage, path_score, seed_prob. Votes of each bridge, best first within a seed."""
    voted = candidates.groupBy("query_id", "seed", "bridge").agg(
        F.countDistinct("passage").alias("votes"), F.max("path_score").alias("best"), F.round(F.max(0.7 * F.col("path_score") + 0.3 * F.col("seed_prob")), 6).alias("confidence")
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("votes"), F.desc("confidence"), F.desc("best"), "bridge"))
    return voted.withColumn("rank", rank).where(F.col("rank") <= per_seed)


def anchor_weights(ranked: DataFrame) -> DataFrame:
    """ranked: query_id, sub_question, passage, rank from 0. Sum of 1 / (1 + rank) over sub-questions, per their number."""
    n = ranked.groupBy("query_id").agg(F.countDistinct("sub_question").alias("n"))
    return ranked.join(n, "query_id").groupBy("query_id", "passage").agg(F.round(F.sum(1 / (1 + F.col("rank")) / F.col("n")), 6).alias("weight"))


def trim_pool(candidates: DataFrame, size: int = 80) -> DataFrame:
    """candidates: query_id, passage, base, goal, goal_score, verified. Verified and each goal's best are reserved."""
    n = candidates.count()  # each task gets a bounded number of rows, however many there are
    best = F.row_number().over(Window.partitionBy("query_id", "goal").orderBy(F.desc("goal_score"), "passage")) == 1
    marked = spread(spread(candidates, "query_id", "goal", rows=n).withColumn("best", best), "query_id", "passage", rows=n).groupBy("query_id", "passage").agg(
        F.max("base").alias("base"), F.max("goal_score").alias("goal_score"), F.bool_or("verified").alias("verified"), F.bool_or("best").alias("best")
    )
    marked = marked.withColumns({"class": F.when(F.col("verified"), 0).when(F.col("best"), 1).otherwise(2), "utility": F.round(0.4 * F.col("base") + 0.6 * F.col("goal_score"), 6)})
    if n > TASK_ROWS * int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marked = spread(marked, "query_id", rows=n)  # else Spark drops most rows before they are exchanged
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("class", F.desc("utility"), "passage"))
    return marked.withColumn("rank", rank).where(F.col("rank") <= size)


def prune_beams(beams: DataFrame, width: int = 3) -> DataFrame:
    """beams: query_id, beam_id, binding, score. Best of each binding, then the best few of a query."""
    first = F.row_number().over(Window.partitionBy("query_id", "binding").orderBy(F.desc("score"), "beam_id"))
    kept = beams.withColumn("_first", first).where("_first = 1").drop("_first")
    return top_k(kept, width, "query_id", "score", "beam_id")


def weak_seeds(queries: DataFrame, entities: DataFrame, idf: DataFrame, least: float = 0.15, top: int = 32, common: int = 1000) -> DataFrame:
    """queries: query_id, tokens; entities: entity, tokens. The best entities of each question among all that share a token
    with it. An entity that is part of the question's text, inside a word or not, counts 1.5, one among its n-grams of up to
    five tokens another 1, shared tokens up to 1.5.

    Pairs that share a token of at most ``common`` entities meet on it, and so do names with the parts of the text that they
    equal. All others share nothing but common tokens; there entities of equal common tokens, size and idf score alike, and
    the first ``top`` names of such a class stand before the rest of it in every question (their own further merits only
    lift them). The result is that of all pairs, which need not be made."""
    name = F.array_join("tokens", " ")
    own = entities.join(idf, "entity").select("entity", "idf", F.col("tokens").alias("own"), name.alias("name"))
    tokens = own.select("entity", "idf", "own", "name", F.explode(F.array_distinct("own")).alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > common).select("t")
    asked = queries.select("query_id", "tokens", name.alias("said"))
    q = asked.select("*", F.explode(F.array_distinct("tokens")).alias("t"))
    columns = ["query_id", "tokens", "said", "entity", "idf", "own", "name"]
    pairs = q.join(tokens.join(often, "t", "left_anti"), "t").select(columns)
    # Names of common tokens that the text holds.
    named = tokens.join(F.broadcast(often), "t").groupBy("entity", "idf", "own", "name").agg(F.array_sort(F.collect_set("t")).alias("_common"))
    longest = named.agg(F.max(F.length("name")).alias("longest"))  # one row
    starts = asked.join(F.broadcast(longest)).where("longest > 0 AND length(said) > 0").withColumn("at", F.explode(F.expr("sequence(1, length(said))")))
    parts = starts.select("query_id", "tokens", "said", F.explode(F.expr("transform(sequence(1, least(longest, length(said) - at + 1)), n -> substring(said, at, n))")).alias("name")).distinct()
    pairs = pairs.unionByName(parts.join(named.drop("_common"), "name").where(F.arrays_overlap("tokens", "own")).select(columns))
    place = F.row_number().over(Window.partitionBy("_common", F.size(F.array_distinct("own")), "idf").orderBy("entity"))
    first = named.withColumn("_n", place).where(F.col("_n") <= top).select("entity", "idf", "own", "name", F.explode("_common").alias("t"))
    pairs = pairs.unionByName(q.join(first, "t").select(columns)).dropDuplicates(["query_id", "entity"])
    whole = F.contains("said", "name").cast("double")
    run = F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" "))).cast("double")
    gram = F.when(F.size("own") <= 5, run).otherwise(0.0)
    shared = F.size(F.array_intersect("tokens", "own")) / F.size(F.array_union("tokens", "own"))
    scored = pairs.withColumn("score", F.round((1.5 * whole + gram + 1.5 * shared) * F.col("idf"), 6))
    return top_k(scored.where(F.col("score") >= least), top, "query_id", "score", "entity").select("query_id", "entity", "score", "rank")


def same_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one side has; empty where an invariant holds."""
    return a.select(keys).exceptAll(b.select(keys)).withColumn("side", F.lit("left")).unionByName(b.select(keys).exceptAll(a.select(keys)).withColumn("side", F.lit("right")))
