"""Experiment operators: detailed rows, sample choice, frozen inputs, control audits, target assessment."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.operators.evaluation import gold_ranks, quotas, recall_at


def detailed_rows(ranked: DataFrame, gold: DataFrame, results: int = 10, candidates: int = 200) -> DataFrame:
    """Per query its first passages, candidate passages, recalls, gold ranks and whether all gold is in the first 5 or 10."""
    listed = ranked.where(F.col("rank") <= candidates).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("all"))  # at most `candidates` a query
    found = gold_ranks(ranked, gold).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("gold_ranks"), F.count(F.lit(1)).alias("n_gold"), *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in (5, 10)])
    docs = F.transform("all", lambda x: x["passage"])
    joined = listed.join(recall_at(ranked, gold), "query_id").join(found, "query_id", "left")
    return joined.select("*", docs.alias("candidate_docs"), F.slice(docs, 1, results).alias("docs"), *[F.coalesce((F.col("n_gold") > 0) & (F.col(f"in_{k}") == F.col("n_gold")), F.lit(False)).alias(f"all_gold_top{k}") for k in (5, 10)]).drop("all", "in_5", "in_10")


def select_samples(rows: DataFrame, ordinal: str, indices: list[int] | None = None, size: int | None = None, seed: int = 42) -> DataFrame:
    """Named ordinals, a seeded sample of them, or all. The ordinals asked for are few; they filter the scan."""
    if indices is None and size is None:
        return rows
    total = rows.count()
    if indices is None:
        indices = sorted(random.Random(seed).sample(range(total), min(size, total)))
    if len(set(indices)) != len(indices) or not all(isinstance(i, int) and 0 <= i < total for i in indices):
        raise ValueError("indices must be distinct and in range")
    return rows.where(F.col(ordinal).isin(indices))


def stratified_indices(rows: DataFrame, strata: list[str], key: str, size: int, seed: int = 1031) -> DataFrame:
    """At least one of each cell, the rest by largest remainder, drawn by hash order. A sampling operator."""
    from pyspark.sql import Window

    counts = {tuple(r[s] for s in strata): r["n"] for r in rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    shares = quotas({repr(k): n for k, n in counts.items()}, size)
    spark = rows.sparkSession
    table = spark.createDataFrame([(*k, shares[repr(k)]) for k in counts], rows.select(*strata).schema.add("_quota", "long"))
    at = F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("_at", at).join(table, strata).where("_at <= _quota").drop("_at", "_quota")


def freeze(state: DataFrame, path: str) -> str:
    """Writes what a finaliser reads, and returns a digest of its rows that does not depend on their order."""
    state.write.mode("errorifexists").parquet(path)
    return digest(state.sparkSession.read.parquet(path))


def replay(spark: SparkSession, path: str, expected: str) -> DataFrame:
    state = spark.read.parquet(path)
    if digest(state) != expected:
        raise ValueError("frozen inputs changed")
    return state


def digest(df: DataFrame) -> str:
    """Sums of row hashes: no gathering, whatever the size."""
    r = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(20,0)")), F.bit_xor("h")).first()
    return ":".join(map(str, r))


def control_audit(calls: DataFrame, pools: DataFrame, expected: DataFrame, budget: int) -> DataFrame:
    """calls: query_id, n; pools and expected: query_id, passage. Queries over budget or with another pool."""
    over = calls.groupBy("query_id").agg(F.sum("n").alias("n")).where(F.col("n") > budget).select("query_id", F.lit("over_budget").alias("issue"))
    both = pools.select("query_id", "passage").exceptAll(expected.select("query_id", "passage")).unionByName(expected.select("query_id", "passage").exceptAll(pools.select("query_id", "passage")))
    return over.unionByName(both.select("query_id", F.lit("other_pool").alias("issue")).distinct())


def target_assessment(deltas: DataFrame, gain: float, unit: str = "points", most_loss: float = 0.0) -> DataFrame:
    """deltas: dataset, base, value. Whether each dataset reaches its target: base plus points, times (1 + gain), or with
    that share of its errors gone; a target above 1 is unreachable."""
    target = {"points": F.col("base") + gain, "relative": F.col("base") * (1 + gain), "errors": F.col("base") + (1 - F.col("base")) * gain}[unit]
    return deltas.select(
        "dataset", F.round(target, 6).alias("target"), (target > 1).alias("unreachable"), (F.col("value") >= target - 1e-12).alias("reached"), (F.col("value") < F.col("base") - most_loss - 1e-12).alias("regressed")
    )


def witness_archive(lines: DataFrame, client: DataFrame) -> DataFrame:
    """Status codes that a server log and a client's counters disagree on; both code, count."""
    both = lines.withColumnRenamed("count", "server").join(client.withColumnRenamed("count", "client"), "code", "full")
    return both.where("server IS DISTINCT FROM client")
