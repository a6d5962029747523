"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One scan computes a thin table of features. The fit needs only count, sum and product sums of each class, gathered by
one aggregation of fixed size; covariances shrink towards the pooled one and its diagonal. Scoring is an arithmetic
expression: forward substitution with the inverse Cholesky factors, which are literals of the plan.

A null text has the features of an empty one and gets a score too. Repeated rows are scored alike; an empty table gives
an empty one. A row without doc_id is not held out, and has no label to learn from. Without labels of both classes there is nothing to learn, and every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from hopweave.llm.text_stats import with_text_stats

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_bangs", "n_bars", "n_stop_words", "n_distinct_words")


def _damped(top: str, bottom: str, usual: float, weight: int) -> str:
    """The ratio after ``weight`` more units at its usual value, so that short texts stay near that value."""
    return f"((cast({top} AS double) + {usual * weight}D) / ({bottom} + {weight}D))"


FEATURES = {
    "f_symbols": f"sqrt({_damped('n_symbols', 'n_words', 0.0, 4)})",
    "f_bangs": f"sqrt({_damped('n_bangs', 'n_words', 0.0, 4)})",
    "f_bars": f"sqrt({_damped('n_bars', 'n_words', 0.0, 4)})",
    "f_capitals": f"sqrt({_damped('n_upper', 'word_chars', 0.017, 200)})",
    "f_word_length": f"ln({_damped('word_chars', 'n_words', 5.0, 40)})",
    "f_stop_words": _damped("n_stop_words", "n_words", 0.24, 40),
    # Distinct words fall with the length of a text; the power takes most of that out.
    "f_distinct": "ln((20D + n_distinct_words) / pow(20D + n_words, 0.93D))",
    "f_dup_lines": f"sqrt({_damped('n_dup_lines', 'n_lines', 0.0, 6)})",
}


def features(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry and the features of each row."""
    counted = with_text_stats(df.select("doc_id", F.col(text).alias("text"), *[c for c in carry if c != "text"]), COUNTS)
    return counted.select("doc_id", *carry, *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])


@dataclass
class Model:
    priors: np.ndarray
    means: np.ndarray  # class x feature
    inverse_factors: list[np.ndarray]  # of the lower Cholesky factors
    log_dets: np.ndarray

    def log_density_sql(self, k: int) -> str:
        """SQL of log prior + log normal density of class k, up to a constant that both share."""
        centred = [f"({name} - ({float(m)!r}D))" for name, m in zip(FEATURES, self.means[k])]
        squares = []
        for row, line in enumerate(self.inverse_factors[k]):
            total = " + ".join(f"({float(line[c])!r}D) * {centred[c]}" for c in range(row + 1))
            squares.append(f"pow({total}, 2D)")
        return f"({float(np.log(self.priors[k]) - self.log_dets[k] / 2)!r}D - 0.5D * ({' + '.join(squares)}))"


def fit(labelled: DataFrame, label: str = "quality", shrink_to_pooled: float = 0.1, shrink_to_diagonal: float = 0.05, floor: float = 1e-4) -> Model | float:
    """labelled: features and a 0/1 label; other labels and nulls are left out. All rows given are used. Without both
    classes, the score that every row gets."""
    names = list(FEATURES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    rows = (
        labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("_k"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s_{a}") for a in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs])
        .collect()
    )
    by = {r["_k"]: r for r in rows}
    if set(by) != {0, 1}:
        return 0.5
    counts = np.array([by[k]["n"] for k in (0, 1)], float)
    means = np.array([[by[k][f"s_{a}"] for a in names] for k in (0, 1)]) / counts[:, None]
    covs = []
    for k in (0, 1):
        c = np.zeros((len(names),) * 2)
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            c[i, j] = c[j, i] = by[k][f"p_{a}_{b}"] / counts[k] - means[k, i] * means[k, j]
        covs.append(c)
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / counts.sum()
    factors, log_dets = [], []
    for c in covs:
        c = (1 - shrink_to_pooled) * c + shrink_to_pooled * pooled
        c = (1 - shrink_to_diagonal) * c + shrink_to_diagonal * np.diag(np.diag(c)) + floor * np.eye(len(names))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Model(counts / counts.sum(), means, factors, np.array(log_dets))


def score(featured: DataFrame, model: Model | float) -> DataFrame:
    """Adds ``score``, the posterior of class 1."""
    if not isinstance(model, Model):
        return featured.withColumn("score", F.lit(model))
    gap = F.expr(f"{model.log_density_sql(0)} - {model.log_density_sql(1)}")
    return featured.withColumn("score", 1.0 / (1.0 + F.exp(F.least(gap, F.lit(700.0)))))


def held_out() -> Column:
    return F.expr("coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, false)")


def classify(docs: DataFrame, labels: DataFrame, scratch, threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns to carry of each row; learns only from labelled rows outside
    the held-out fifth."""
    table = scratch.keep(features(docs, carry=carry))
    truth = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = fit(table.where(~held_out()).join(truth, "doc_id"))
    return score(table, model).select("doc_id", held_out().alias("held_out"), "score", F.expr(f"int(score >= {threshold}D)").alias("predicted"), *carry)
