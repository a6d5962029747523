"""Evaluation operators: recall, exact match, token F1, strata, weights, paired differences, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hopweave.functions.text import answer_norm, tokens

KS = (1, 2, 5, 10, 20, 200)


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per query the share of its distinct gold passages among the first k; 0 for a query without gold.

    ranked: query_id, passage, rank from 1; gold: query_id, passage; queries are those of ranked."""
    golds = gold.select("query_id", "passage").distinct()
    found = golds.join(ranked, ["query_id", "passage"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    return ranked.select("query_id").distinct().join(found, "query_id", "left").select("query_id", *[F.coalesce(F.col(f"h{k}") / F.col("n"), F.lit(0.0)).alias(f"recall_{k}") for k in ks])


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.select("query_id", "passage").distinct().join(ranked, ["query_id", "passage"], "left").select("query_id", "passage", "rank")


def exact_match(answers: DataFrame) -> DataFrame:
    """answers: query_id, gold, predicted (a row for each gold). 1 if any gold is equal once normalised."""
    return answers.groupBy("query_id").agg(F.max((answer_norm(F.col("gold")) == answer_norm(F.col("predicted"))).cast("int")).alias("em"))


ROWS_AT_ONCE = 256  # pairs of token lists sorted together


def _same_tokens(batches):
    """Multiset overlap of each row's two lists of token hashes, by one sort of the (row, token) pairs of a few rows."""
    import numpy as np
    import pyarrow as pa

    for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
        rows, flat = [], []
        for c in (1, 2):
            lists = batch.column(c)
            n = np.diff(lists.offsets.to_numpy())
            rows.append(np.repeat(np.arange(len(lists)), n))
            flat.append(lists.flatten().to_numpy(zero_copy_only=False))
        row, token = np.concatenate(rows), np.concatenate(flat)
        side = np.repeat([0, 1], [len(flat[0]), len(flat[1])])
        order = np.lexsort((token, row))
        row, token, side = row[order], token[order], side[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(token) != 0)])) if len(row) else np.zeros(0, int)
        right = np.add.reduceat(side, new) if len(new) else new
        total = np.diff(np.append(new, len(row)))
        same = np.bincount(row[new], np.minimum(right, total - right), len(batch.column(0))) if len(new) else np.zeros(batch.num_rows)
        all_tokens = np.bincount(row, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2 * same / np.maximum(1, all_tokens))], names=["query_id", "f1"])


def token_f1(answers: DataFrame) -> DataFrame:
    """Multiset token overlap, the best over golds. Both lists of tokens are in one row, so nothing but a pair's score is
    exchanged; tokens are compared by 64-bit hashes within their row."""
    hashes = lambda c: F.transform(tokens(answer_norm(F.col(c))), lambda t: F.xxhash64(t))
    empty = F.array().cast("array<bigint>")
    rows = answers.select("query_id", F.coalesce(hashes("gold"), empty).alias("g"), F.coalesce(hashes("predicted"), empty).alias("p"))
    scores = rows.mapInArrow(_same_tokens, f"query_id {dict(answers.dtypes)['query_id']}, f1 double")
    return scores.groupBy("query_id").agg(F.round(F.max("f1"), 6).alias("f1"))


def stratified(rows: DataFrame, metrics: list[str], stratum: str = "hops") -> DataFrame:
    """Overall and by stratum in one pass of grouping sets; the overall row has a null stratum."""
    means = ", ".join(f"round(avg({m}), 4) AS {m}" for m in metrics)
    view = f"_strata_{abs(hash((tuple(metrics), stratum)))}"
    rows.createOrReplaceTempView(view)
    return rows.sparkSession.sql(f"SELECT {stratum}, count(1) AS n, {means} FROM {view} GROUP BY GROUPING SETS ((), ({stratum}))")


def poststratification(population: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """Weights N_h / N / n_h of a stratum's sampled rows."""
    big = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    small = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = population.agg(F.count(F.lit(1)).alias("total"))  # one row
    return big.join(small, stratum).join(F.broadcast(total)).select(stratum, "size", "n", (F.col("size") / F.col("total") / F.col("n")).alias("weight"))


def weighted_means(sample: DataFrame, weights: DataFrame, stratum: str, metrics: list[str]) -> DataFrame:
    joined = sample.join(weights.select(stratum, "weight"), stratum)
    return joined.agg(*[F.round(F.sum(F.col("weight") * F.col(m)) / F.sum("weight"), 6).alias(m) for m in metrics], F.round(F.sum("weight") ** 2 / F.sum(F.col("weight") ** 2), 6).alias("ess"))


def paired(base: DataFrame, other: DataFrame, metric: str) -> DataFrame:
    """Mean difference, wins, losses and ties of rows of equal query_id; refuses unmatched rows by counting them."""
    both = base.select("query_id", F.col(metric).alias("x")).join(other.select("query_id", F.col(metric).alias("y")), "query_id", "full")
    d = F.col("y") - F.col("x")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"), F.round(F.avg(d), 6).alias("mean_difference"),
        F.count_if(d > 1e-12).alias("wins"), F.count_if(d < -1e-12).alias("losses"), F.count_if(F.abs(d) <= 1e-12).alias("ties"),
    )


LEAF_ROWS, MOST_LEAVES, AT_ONCE = 4096, 4096, 100


def _draws(sizes: list[int], leaf: int, seed: list[int], repetitions: int):
    """How many of each repetition's draws fall on a leaf, of as many draws as there are rows. Going down a tree over the
    leaves, each node's draws are split by a binomial draw whose seed is the node's, so all leaves agree on it."""
    import numpy as np

    low, high, node = 0, len(sizes), 1
    m = np.full(repetitions, sum(sizes))
    while high - low > 1:
        middle = (low + high) // 2
        left, total = sum(sizes[low:middle]), sum(sizes[low:high])
        taken = np.random.default_rng([*seed, node]).binomial(m, left / total if total else 0.0)
        if leaf < middle:
            m, high, node = taken, middle, 2 * node
        else:
            m, low, node = m - taken, middle, 2 * node + 1
    return m


def _leaf_sums(sizes: dict, repetitions: int, seed: int):
    import numpy as np
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        stratum, leaf = int(group["stratum_no"].iloc[0]), int(group["leaf"].iloc[0])
        d = group.sort_values(["row_id", "d"])["d"].to_numpy(float)
        m = _draws(sizes[stratum], leaf, [seed, stratum], repetitions)
        rng, sums = np.random.default_rng([seed, stratum, leaf, 0]), np.zeros(repetitions)
        for begin in range(0, repetitions, AT_ONCE):
            own = m[begin : begin + AT_ONCE]
            drawn = d[rng.integers(0, len(d), int(own.sum()))]
            sums[begin : begin + AT_ONCE] = np.bincount(np.repeat(np.arange(len(own)), own), drawn, len(own))
        return pd.DataFrame({"rep": np.arange(repetitions), "total": sums})

    return run


def bootstrap_interval(rows: DataFrame, repetitions: int = 2000, seed: int = 42) -> DataFrame:
    """Order-statistic 95 % interval of the mean difference: rows (stratum, d, row_id), resampled within strata.

    Each repetition draws exactly as many rows of a stratum as it has. Rows lie in leaves by a hash of their id; how many
    draws fall on a leaf comes from a tree of binomial splits, and the leaf makes them. No row is copied, only a sum for
    each leaf and repetition leaves its task, and a lost task repeats its draws. A null d is left out."""
    real = rows.where("d IS NOT NULL").select("stratum", "d", "row_id")
    strata = [r["stratum"] for r in real.select("stratum").distinct().orderBy("stratum").collect()]  # few
    leaves = max(1, min(MOST_LEAVES, -(-real.count() // LEAF_ROWS)))
    number = sum((F.when(F.col("stratum").eqNullSafe(F.lit(s)), i).otherwise(0) for i, s in enumerate(strata)), F.lit(0))
    placed = real.select("d", "row_id", number.alias("stratum_no"), F.expr(f"int(pmod(xxhash64(row_id), {leaves}))").alias("leaf"))
    sizes = {i: [0] * leaves for i in range(len(strata))}
    for r in placed.groupBy("stratum_no", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_LEAVES a stratum
        sizes[r["stratum_no"]][r["leaf"]] = r["n"]
    total = sum(map(sum, sizes.values()))
    sums = placed.groupBy("stratum_no", "leaf").applyInPandas(_leaf_sums(sizes, repetitions, seed), "rep int, total double")
    # Decimals add up to the same in any order.
    means = sums.groupBy("rep").agg((F.sum(F.col("total").cast("decimal(38,12)")).cast("double") / F.lit(float(max(total, 1)))).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"), F.count(F.lit(1)).alias("n"))  # `repetitions` values
    at = lambda q: F.get("m", F.floor(q * (F.col("n") - 1)).cast("int"))
    return ordered.select(at(0.025).alias("low"), at(0.975).alias("high"))


def stratified_subset(rows: DataFrame, stratum: str, key: str, share: float, least: int = 2, seed: int = 1031) -> DataFrame:
    """The first rows of each stratum in an order by hash: the same whatever the partitioning. A sampling operator."""
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    size = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    return rows.withColumn("_at", order).withColumn("_quota", F.greatest(F.least(F.lit(least), size), F.floor(share * size))).where("_at <= _quota").drop("_at", "_quota")


def quotas(counts: dict[str, int], size: int, least: int = 1) -> dict[str, int]:
    """Largest-remainder shares of a sample size, with a minimum for each stratum that has rows."""
    total = sum(counts.values())
    exact = {k: size * n / total for k, n in counts.items()}
    out = {k: min(counts[k], max(least, int(x))) for k, x in exact.items()}
    by_rest = sorted(exact, key=lambda k: (-(exact[k] - int(exact[k])), k))
    while sum(out.values()) != size:
        short = sum(out.values()) < size
        ready = [k for k in (by_rest if short else by_rest[::-1]) if (out[k] < counts[k] if short else out[k] > least)]
        if not ready:
            break
        for k in ready:
            if sum(out.values()) == size:
                break
            out[k] += 1 if short else -1
    return out


def difficulty(prefix: str = "recall_"):
    full = 1 - 1e-12
    return F.when(F.col(f"{prefix}5") >= full, "top5").when(F.col(f"{prefix}10") >= full, "top10").when(F.col(f"{prefix}200") >= full, "top200").otherwise("missing200")


def improvement_score(deltas: DataFrame) -> DataFrame:
    """deltas: dataset, d5, d10, d_all5. Scored 0.6, 0.25, 0.15; eligible if means rise and no dataset falls by 0.02."""
    return deltas.agg(
        F.round(F.avg(0.6 * F.col("d5") + 0.25 * F.col("d10") + 0.15 * F.col("d_all5")), 6).alias("score"),
        ((F.avg("d5") > 0) & (F.avg("d10") >= 0) & (F.min("d5") >= -0.02)).alias("eligible"),
    )
