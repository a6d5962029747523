"""Vector and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def minmax(c: Column, *by: str, least_range: float = 0.0) -> Column:
    """Scaled to 0..1 within a group; one that (nearly) does not vary is all ones."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low <= least_range, F.lit(1.0)).otherwise((c - low) / (high - low))


def softmax(c: Column, *by: str, temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp((c - F.max(c).over(w)) / max(temperature, 1e-4))
    return e / (F.sum(e).over(w) + 1e-12)


def local_rank(c: Column, tie: str, *by: str, constant: int = 10) -> Column:
    """0.75 * c / (c + rank) + 0.25 * minmax, rank from 1 by descending score."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(c.desc(), tie))
    return 0.75 * constant / (constant + rank) + 0.25 * minmax(c, *by)


def beam_score(qualities: Column, total: Column) -> Column:
    """0.45 * least + 0.35 * mean + 0.20 * coverage; 0 for an empty beam."""
    n = F.size(qualities)
    mean = F.aggregate(qualities, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(0.45 * F.array_min(qualities) + 0.35 * mean + 0.20 * n / F.greatest(F.lit(1), total))
