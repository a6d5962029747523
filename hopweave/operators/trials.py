"""Experiment jobs: representative draws, difficulty splits, grids of methods, recomputed cases, attribution, throughput."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.operators.evaluation import quotas


def representative_draw(counts: dict[tuple, int], marginals: list[dict], size: int, seed: int = 42) -> dict[tuple, int]:
    """How many rows to take of each cell (one value for each attribute), one at a time: from the cell that brings the drawn
    shares of all attributes nearest to the population's. Ties by seed. Cells are few; rows never come here."""
    rng, taken, total = random.Random(seed), dict.fromkeys(counts, 0), sum(counts.values())
    goal = [{v: n / max(1, total) for v, n in m.items()} for m in marginals]
    drawn = [dict.fromkeys(m, 0) for m in marginals]
    for step in range(1, min(size, total) + 1):
        def gap(cell: tuple) -> float:
            return sum(abs((drawn[k][v] + (cell[k] == v)) / step - share) for k, g in enumerate(goal) for v, share in g.items())
        open_cells = sorted(c for c in counts if taken[c] < counts[c])
        least = min(round(gap(c), 12) for c in open_cells)
        cell = rng.choice([c for c in open_cells if round(gap(c), 12) == least])
        taken[cell] += 1
        for k, v in enumerate(cell):
            drawn[k][v] += 1
    return taken


def draw(rows: DataFrame, attributes: list[str], key: str, size: int, seed: int = 42) -> DataFrame:
    """The representative draw of whole rows: cells by the rule above, rows of a cell by hash order. A sampling operator."""
    from pyspark.sql import Window

    cells = {tuple(r[a] for a in attributes): r["n"] for r in rows.groupBy(*attributes).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    marginals = [{} for _ in attributes]
    for cell, n in cells.items():
        for m, v in zip(marginals, cell):
            m[v] = m.get(v, 0) + n
    shares = representative_draw(cells, marginals, size, seed)
    table = rows.sparkSession.createDataFrame([(*c, n) for c, n in shares.items()], rows.select(*attributes).schema.add("_quota", "long"))
    at = F.row_number().over(Window.partitionBy(*attributes).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("_at", at).join(table, attributes).where("_at <= _quota").drop("_at", "_quota")


def difficulty_split(rows: DataFrame, stratum: str, difficulty: str, key: str, size: int, seed: int = 1031) -> DataFrame:
    """A draw of ``size`` rows by (stratum, difficulty); if there are more cells than rows, a stratum's difficulties are merged
    into one cell, smallest strata first. Adds ``cell``."""
    from pyspark.sql import Window

    counts = {(r[stratum], r[difficulty]): r["n"] for r in rows.groupBy(stratum, difficulty).agg(F.count(F.lit(1)).alias("n")).collect()}
    strata: dict = {}
    for (s, _), n in counts.items():
        strata[s] = strata.get(s, 0) + n
    name = {c: f"{c[0]}|{c[1]}" for c in counts}
    for s in sorted(strata, key=lambda s: (strata[s], str(s))):
        if len(set(name.values())) <= size:
            break
        name |= {c: f"{s}|any" for c in counts if c[0] == s}
    sums: dict[str, int] = {}
    for c, n in counts.items():
        sums[name[c]] = sums.get(name[c], 0) + n
    shares = quotas(sums, size, 1 if len(sums) <= size else 0)
    schema = rows.select(stratum, difficulty).schema.add("cell", "string").add("_quota", "long")
    table = rows.sparkSession.createDataFrame([(*c, name[c], shares[name[c]]) for c in counts], schema)
    at = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.join(F.broadcast(table), [stratum, difficulty]).withColumn("_at", at).where("_at <= _quota").drop("_at", "_quota")  # one row a cell


def grid(spark: SparkSession, datasets: dict[str, DataFrame], methods: dict[str, Callable[[DataFrame], DataFrame]], keep) -> DataFrame:
    """Every method on every data set: (dataset, method, and the metrics of its one result row), each written when done."""
    out = None
    for (name, data), (method, run) in itertools.product(datasets.items(), methods.items()):
        row = keep(run(data).select(F.lit(name).alias("dataset"), F.lit(method).alias("method"), "*"))
        out = row if out is None else out.unionByName(row)
    return out


def case_table(reports: DataFrame, metrics: list[str]) -> DataFrame:
    """reports: run, method, metrics (map). One row a run; missing metrics are null."""
    return reports.select("run", "method", *[F.round(F.try_element_at("metrics", F.lit(m)), 4).alias(m) for m in metrics])


def recompute(per_query: DataFrame, published: DataFrame, tolerance: float = 0.00011) -> DataFrame:
    """per_query: case, hops, recall; published: case, hops, value. Macro means rounded to four places beside what was
    published, and whether they agree."""
    means = per_query.groupBy("case", "hops").agg(F.round(F.avg("recall"), 4).alias("recomputed"), F.count(F.lit(1)).alias("n"))
    both = means.join(published, ["case", "hops"], "full")
    agree = F.coalesce(F.abs(F.col("recomputed") - F.col("value")) <= tolerance, F.lit(False))
    return both.select("case", "hops", "n", "recomputed", F.col("value").alias("published"), agree.alias("agrees"))


def label_agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """One row: rows labelled by both, how many agree, and Cohen's kappa."""
    both = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    counts = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # pairs of labels
    n = sum(r.n for r in counts)
    same = sum(r.n for r in counts if r.x == r.y)
    left, right = {}, {}
    for r in counts:
        left[r.x] = left.get(r.x, 0) + r.n
        right[r.y] = right.get(r.y, 0) + r.n
    chance = sum(left[v] * right.get(v, 0) for v in left) / n**2 if n else 0.0
    kappa = (same / n - chance) / (1 - chance) if n and chance < 1 else 1.0
    return a.sparkSession.createDataFrame([(n, same, round(kappa, 6))], "n long, agreed long, kappa double")


def attribute_swaps(swaps: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """swaps: query_id, mechanism; before and after: query_id, recall. What each mechanism won and lost."""
    gain = F.col("after") - F.col("before")
    both = swaps.join(before.select("query_id", F.col("recall").alias("before")), "query_id").join(after.select("query_id", F.col("recall").alias("after")), "query_id")
    return both.groupBy("mechanism").agg(F.count(F.lit(1)).alias("swaps"), F.count_if(gain > 0).alias("helped"), F.count_if(gain < 0).alias("hurt"), F.round(F.sum(gain), 6).alias("net"))


def throughput(run: Callable[[], DataFrame], repeats: int = 3) -> list[tuple[float, int]]:
    """Seconds and rows of each cold run; nothing is cached between them."""
    out = []
    for _ in range(repeats):
        begin = time.time()
        out.append((0.0, run().count()))
        out[-1] = (time.time() - begin, out[-1][1])
    return out
