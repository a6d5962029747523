"""Path hints of a query: pairs of a seed and a bridge entity that its first passages support.

Candidates come in three tiers, each only for queries that the tiers before left without any:
1. pairs of seed and neighbour whose neighbour stands in a first passage;
2. seeds and the rarest other entities of the same passage;
3. the very first passage alone, with its seeds (or the query's first seed) and its rarest entities, without tests.
Tiers 1 and 2 ask for a least passage score and for a bridge that the passage's text supports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hopweave.functions.numeric import minmax
from hopweave.operators.extraction import entity_supported

PATH_SHARE, SEED_SHARE = 0.7, 0.3  # of a hint's confidence


def candidates(ranked: DataFrame, seeds: DataFrame, bridges: DataFrame, holds: DataFrame, idf: DataFrame, texts: DataFrame, keep, top_docs: int = 10, pool: int = 10, least: float = 0.1) -> DataFrame:
    """ranked: query_id, passage, rank, score; seeds: query_id, seed, prob; bridges: query_id, seed, bridge; holds: passage,
    entity; idf: entity, idf; texts: passage, text. (query_id, seed, bridge, passage, path_score, prob, tier)."""
    first = ranked.where(F.col("rank") <= top_docs).withColumn("path_score", minmax(F.col("score"), "query_id"))
    docs = keep(first.select("query_id", "passage", "rank", "path_score").join(seeds.select("query_id").distinct(), "query_id", "left_semi"))
    inside = keep(docs.join(holds.select("passage", "entity").distinct(), "passage").join(idf.select("entity", "idf"), "entity", "left").join(texts.select("passage", "text"), "passage", "left"))
    tested = inside.where((F.col("path_score") >= least) & F.coalesce(entity_supported(F.col("entity"), F.col("text")), F.lit(False)))
    # Entities of a passage that are no seeds, the rarest first.
    others = inside.join(seeds.select("query_id", F.col("seed").alias("entity")), ["query_id", "entity"], "left_anti")
    order = F.row_number().over(Window.partitionBy("query_id", "passage").orderBy(F.desc(F.coalesce("idf", F.lit(1.0))), "entity"))
    rare = keep(others.withColumn("_n", order).where(F.col("_n") <= pool))
    held_seeds = inside.join(seeds.select("query_id", F.col("seed").alias("entity")), ["query_id", "entity"], "left_semi").select("query_id", "passage", F.col("entity").alias("seed"))
    columns = ["query_id", "seed", "bridge", "passage", "path_score"]

    one = keep(bridges.join(tested.withColumnRenamed("entity", "bridge"), ["query_id", "bridge"]).select(*columns).distinct())
    answered = one.select("query_id").distinct()
    mined = rare.join(answered, "query_id", "left_anti").join(held_seeds, ["query_id", "passage"]).withColumnRenamed("entity", "bridge")
    fit = (F.col("path_score") >= least) & F.coalesce(entity_supported(F.col("bridge"), F.col("text")), F.lit(False))
    two = keep(mined.where(fit).select(*columns))
    answered = answered.unionByName(two.select("query_id").distinct())
    top = rare.where("rank = 1").join(answered, "query_id", "left_anti")
    own = held_seeds.join(docs.where("rank = 1").select("query_id", "passage"), ["query_id", "passage"], "left_semi")
    lowest = seeds.groupBy("query_id").agg(F.min("seed").alias("seed")).join(own.select("query_id").distinct(), "query_id", "left_anti")
    three = top.join(own.select("query_id", "seed").unionByName(lowest), "query_id").withColumnRenamed("entity", "bridge").select(*columns)
    tiers = [t.withColumn("tier", F.lit(i)) for i, t in enumerate((one, two, three), 1)]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).join(seeds.select("query_id", "seed", "prob"), ["query_id", "seed"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def hints(found: DataFrame, idf: DataFrame, per_seed: int = 1, most: int = 10) -> DataFrame:
    """found: candidates. (query_id, seed, bridge, tier, votes, best, confidence, passages, conflict, hint_id): bridges of a
    seed go by votes, confidence, score, rarity and name; the best ``per_seed`` of each stay, then the ``most`` surest of a
    query. conflict: the share of the query's seeds that had several bridges before the vote."""
    confidence = PATH_SHARE * F.col("path_score") + SEED_SHARE * F.col("prob")
    voted = found.groupBy("query_id", "seed", "bridge").agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("votes"), F.max("path_score").alias("best"), F.round(F.max(confidence), 6).alias("confidence"), F.array_sort(F.collect_set("passage")).alias("passages"))
    rivals = voted.groupBy("query_id", "seed").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("conflict"))
    rare = voted.join(idf.select(F.col("entity").alias("bridge"), "idf"), "bridge", "left")
    vote = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("votes"), F.desc("confidence"), F.desc("best"), F.desc(F.coalesce("idf", F.lit(1.0))), "bridge"))
    kept = rare.withColumn("_v", vote).where(F.col("_v") <= per_seed)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("votes"), "seed", "bridge")) - 1
    return kept.withColumn("hint_id", place).where(F.col("hint_id") < most).join(rivals, "query_id").select("query_id", "seed", "bridge", "tier", "votes", "best", "confidence", "passages", "conflict", "hint_id")
