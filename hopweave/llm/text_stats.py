"""Statistics of whole texts as built-in Spark expressions, shared by the quality operators.

Words are runs of characters other than space and U+0009 to U+000D. A null text has no words and empty counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hopweave.llm.columns import with_other_names

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for on with as was it be by are this from at or an than not which",
    "der die das und ist nicht ein eine zu den von mit sich des auf für im dem",
    "le la les de des et est un une du que qui dans pour par sur pas au en ne",
    "el la los las de que y en un una por con para del se al es su lo",
)
_POS_BITS = 24  # positions of a text's words; longer texts take 31


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def count_of(text: str, chars: str) -> str:
    """SQL: how many characters of ``text`` are among ``chars``."""
    listed = chars.replace("\\", "\\\\").replace("'", "\\'")
    return f"(length({text}) - length(translate({text}, '{listed}', '')))"


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_bars", "n_stop_words", "n_distinct_words")


def with_text_stats(df: DataFrame, names: tuple[str, ...] = STATS, text: str = "text") -> DataFrame:
    """Adds the named counts as longs, in place of columns of those names: narrow projections, no shuffle, no user
    function. Only what is asked for is computed.

    Repeated words are found by sorting (hash prefix, position) as plain longs and comparing whole 64-bit hashes of
    neighbours, so the cost is n log n in the words of a text, however often a window repeats.
    """
    inner = {"_t", "_z", "_w", "_l", "_x", "_h", "_s", "_f"}
    return with_other_names(df, inner, text, lambda d, t: _counted(d, names, t))


def _counted(df: DataFrame, names: tuple[str, ...], text: str) -> DataFrame:
    stop = "', '".join(sorted({w for line in STOP_WORDS for w in line.split()}))
    def repeated(bits: int) -> str:
        """SQL: positions of the windows that occur twice or more, in any order."""
        high, low = -(1 << bits), (1 << bits) - 1
        same = f"((x ^ get(_s, {{k}})) & {high}L = 0L AND get(_h, int(x & {low}L)) = get(_h, int(get(_s, {{k}}) & {low}L)))"
        return f"transform(filter(_s, (x, k) -> coalesce({same.format(k='k - 1')}, false) OR coalesce({same.format(k='k + 1')}, false)), x -> int(x & {low}L))"

    def packed(bits: int) -> str:
        return f"sort_array(transform(_h, (x, i) -> (x & {-(1 << bits)}L) | bigint(i)))"

    short = f"size(_h) < {1 << _POS_BITS}"
    letters = "".join(map(chr, range(65, 91)))
    staged = (
        df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_z", F.expr(f"regexp_replace(_t, '[^{SYMBOLS}!A-Z]+', '')"))  # the few characters that are counted
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", F.expr(r"filter(split(_t, '\n'), x -> btrim(x, ' \t\n\u000b\f\r') != '')"))
        .withColumn("_x", F.expr("transform(_w, x -> xxhash64(x))"))
        .withColumn("_h", F.expr("CASE WHEN size(_x) >= 3 THEN transform(slice(_x, 1, size(_x) - 2), (x, i) -> xxhash64(x, get(_x, i + 1), get(_x, i + 2))) ELSE cast(array() AS array<bigint>) END"))
        .withColumn("_s", F.expr(f"CASE WHEN size(array_distinct(_h)) = size(_h) THEN cast(array() AS array<bigint>) WHEN {short} THEN {packed(_POS_BITS)} ELSE {packed(31)} END"))
        .withColumn("_f", F.expr(f"CASE WHEN {short} THEN {repeated(_POS_BITS)} ELSE {repeated(31)} END"))
    )
    counts = {
        "n_words": "size(_w)",
        "word_chars": "length(array_join(_w, ''))",
        "n_symbols": count_of("_z", SYMBOLS),
        "n_dup_lines": "size(_l) - size(array_distinct(_l))",
        "n_repeat_words": "size(array_distinct(flatten(transform(_f, x -> array(x, x + 1, x + 2)))))",
        "n_lines": "size(_l)",
        "n_upper": count_of("_z", letters),
        "n_bangs": count_of("_z", "!"),
        "n_bars": count_of("_z", "|"),
        "n_stop_words": f"size(filter(_w, x -> lower(x) IN ('{stop}')))",
        "n_distinct_words": "size(array_distinct(_w))",
    }
    kept = [c for c in df.columns if c.lower() not in names]
    return staged.select(*kept, *[F.expr(f"bigint({counts[n]})").alias(n) for n in names])
