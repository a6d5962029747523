"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Each rule bounds a ratio of two counts of a text. Rules with a minimum of lines or words say nothing about smaller
texts. Ratios of an empty text are 0. A null text counts as one without words, which the length rule fails; repeated rows are judged
row by row; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hopweave.llm.text_stats import with_text_stats


@dataclass(frozen=True)
class Rule:
    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None
    scope: str = "true"  # SQL over the counts: where the rule applies

    def sql(self) -> str:
        ratio = f"coalesce(cast({self.top} AS double) / nullif(cast({self.bottom} AS double), 0D), 0D)"
        bad = [f"{ratio} < {self.low}D"] * (self.low is not None) + [f"{ratio} > {self.high}D"] * (self.high is not None)
        return f"(({self.scope}) AND ({' OR '.join(bad)}))"


MIN_WORDS, REPEAT_PERCENT = 50, 50
BASE = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)"
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("exclamation", "n_bangs", "n_words", high=0.25),
    Rule("bars", "n_bars", "n_words", high=0.2),
    Rule("capitals", "n_upper", "word_chars", high=0.45),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, scope="n_words >= 100"),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4, scope="n_lines >= 5"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_bars", "n_stop_words")


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``failed_rules`` (names in table order) and ``kept``; replaces columns of those names."""
    own = ("base_failed", "failed_rules", "kept")
    df = with_text_stats(df.drop(*[c for c in df.columns if c.lower() in own and c != text]), COUNTS, text)
    failed = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in rules)
    judged = df.withColumns({"base_failed": F.expr(BASE), "failed_rules": F.expr(f"array_compact(array({failed}))") if rules else F.expr("cast(array() AS array<string>)")})
    return judged.withColumn("kept", F.expr("NOT base_failed AND size(failed_rules) = 0"))
