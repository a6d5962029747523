"""Secret scans with built-in functions only: three base patterns, and windows of high Shannon entropy.

Base spans are leftmost, non-overlapping matches of each pattern; those that fail their length test are dropped.
Candidates are runs of 20 or more characters of base64, with a letter and a digit. A window of 20 characters slides over each; counts of the
characters in the window change by one in and one out, and with them the sum of n * log2(n), so a step costs the same
whatever came before. Windows at or above the threshold of the string's class (hex, or mixed) merge into spans. Strings
on the allow list (UUIDs, digests of nothing, words such as example) add nothing; of a span that meets base spans, what
lies outside them is left.

Places come from running sums that double their reach a pass, and long candidates are cut into overlapping pieces, so
that time grows with n log n of the matches of a text, not with their square.

Places are code points, ends exclusive. A null text is empty and has no spans. Repeated rows are scanned each; an empty
table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from hopweave.llm.columns import with_other_names

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABETS = {"hex": "0123456789abcdef", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
THRESHOLDS = {"hex": 2.9, "mixed": 3.7}
# Strings that look random and are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
    r"^[A-Za-z]+([_=/+-][A-Za-z]+)*[_=/+-]?[0-9]{1,4}$",
)
CHUNK = 256  # places at which windows of one piece of a candidate begin
FEW = 64  # spans up to which a text is cut by places, above which by characters
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, op: str = "x + {}") -> str:
    """SQL: running sums (or other folds) of an array of numbers; each pass reaches twice as far back."""
    back = op.format("get(acc, i - shiftleft(1, k))")
    return f"aggregate(sequence(0, length(bin(size({values})))), {values}, (acc, k) -> transform(acc, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN {back} ELSE x END))"


def _joined(ranges: str, upto: str) -> str:
    """SQL: ranges, by start, joined where one begins at or before ``upto``, the greatest end of those before it, ends."""
    starts = f"filter({ranges}, (x, i) -> i = 0 OR x.start > get({upto}, i - 1))"
    ends = f"filter(zip_with({ranges}, {upto}, (x, e) -> named_struct('start', x.start, 'end', e)), (x, i) -> i = size({ranges}) - 1 OR get({ranges}, i + 1).start > x.end)"
    return f"zip_with({starts}, {ends}, (x, y) -> named_struct('start', x.start, 'end', y.end))"


def _with_places(df: DataFrame, name: str, pattern: str, kind: int, keep: str) -> DataFrame:
    """Adds spans of the matches as ``name``, each with its string ``m``; found from the lengths of what lies between.

    ``keep`` is SQL over a match x. Staged in columns, so that each regular expression runs once a row, and the second
    one only in rows with a match.
    """
    empty = "cast(array() AS array<struct<start:int,end:int,m:string>>)"
    found = df.withColumn("_m", F.expr(f"regexp_extract_all(_t, {_literal(pattern)}, 0)"))
    found = found.withColumn("_g", F.expr(f"CASE WHEN size(_m) = 0 THEN cast(array() AS array<int>) ELSE zip_with(_m, slice(split(_t, {_literal(pattern)}, -1), 1, size(_m)), (m, g) -> length(m) + length(g)) END"))
    return found.withColumn(name, F.expr(f"CASE WHEN size(_m) = 0 THEN {empty} ELSE filter(zip_with(_m, _ends, (m, e) -> named_struct('start', e - length(m), 'end', e, 'm', m)), x -> {keep}) END".replace("_ends", _running("_g")))).drop("_m", "_g")


def _windows(text: str, kind: str) -> str:
    """SQL: merged ranges [start, end) of ``text`` whose windows reach the threshold of the class."""
    alphabet, w = ALPHABETS[kind], WINDOW
    gain = ", ".join(f"{n * math.log2(n) - (n - 1) * math.log2(n - 1) if n > 1 else 0.0!r}D" for n in range(1, w + 1))  # what the n-th equal character adds to the sum
    at = lambda place: f"instr('{alphabet}', {'lower(' if kind == 'hex' else '('}substring({text}, {place} + 1, 1)))"
    zero = f"named_struct('n', array_repeat(0, {len(alphabet)}), 'sum', 0D, 'out', cast(array() AS array<struct<start:int,end:int>>))"
    leave = f"CASE WHEN j >= {w} THEN {at(f'j - {w}')} ELSE 0 END"
    # One character leaves, then one enters; x is (leaving, entering) as places in the alphabet, 0 for none.
    counts = "transform(acc.n, (n, k) -> n + int(k + 1 = x.enter) - int(k + 1 = x.leave))"
    left = f"(acc.sum - CASE WHEN x.leave > 0 THEN element_at(array({gain}), element_at(acc.n, x.leave)) ELSE 0D END)"
    total = f"({left} + element_at(array({gain}), element_at(acc.n, x.enter) - int(x.enter = x.leave) + 1))"
    enough = f"(j >= {w - 1} AND {math.log2(w)!r}D - {total} / {w}D >= {THRESHOLDS[kind]}D)"
    last = "element_at(acc.out, -1)"
    merged = (
        f"CASE WHEN NOT {enough} THEN acc.out WHEN size(acc.out) > 0 AND {last}.end >= j - {w - 1} "
        f"THEN concat(slice(acc.out, 1, size(acc.out) - 1), array(named_struct('start', {last}.start, 'end', j + 1))) "
        f"ELSE concat(acc.out, array(named_struct('start', j - {w - 1}, 'end', j + 1))) END"
    )
    new = f"named_struct('n', {counts}, 'sum', {total}, 'out', {merged})"
    step = f"element_at(transform(array(named_struct('leave', {leave}, 'enter', {at('j')})), x -> {new}), 1)"
    return f"aggregate(sequence(0, length({text}) - 1), {zero}, (acc, j) -> {step}, acc -> acc.out)"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``secret_spans``: an array of (start, kind, end), kind an index of KINDS, by start and then kind."""
    inner = {"_t", "_m", "_g", "_assign", "_access", "_hex", "_long", "_base", "_r", "_u", "_v", "_p", "_entropy"}
    return with_other_names(docs, inner, text, _find)


def _find(docs: DataFrame, text: str) -> DataFrame:
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = _with_places(df, "_assign", ASSIGN, 0, f"length(regexp_extract(x.m, {_literal(ASSIGN)}, 2)) >= {LEAST_VALUE}")
    df = _with_places(df, "_access", ACCESS, 1, "true")
    df = _with_places(df, "_hex", HEX, 2, "true")
    allowed = " OR ".join(f"x.m RLIKE {_literal(p)}" for p in ALLOWED)
    df = _with_places(df, "_long", CANDIDATE, 3, f"x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]' AND NOT ({allowed})")
    spans = [f"transform({name}, x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end))" for k, name in enumerate(("_assign", "_access", "_hex"))]
    df = df.withColumn("_base", F.expr(f"concat({', '.join(spans)})"))
    ranges = lambda kind: f"flatten(transform(transform(array(substring(c.m, b * {CHUNK} + 1, {CHUNK + WINDOW - 1})), s -> {_windows('s', kind)}), p -> transform(p, r -> named_struct('start', c.start + b * {CHUNK} + r.start, 'end', c.start + b * {CHUNK} + r.end))))"
    pieces = f"flatten(transform(sequence(0, (length(c.m) - {WINDOW}) div {CHUNK}), b -> CASE WHEN c.hex THEN {ranges('hex')} ELSE {ranges('mixed')} END))"
    classed = "transform(_long, c -> named_struct('start', c.start, 'm', c.m, 'hex', c.m RLIKE '^([0-9a-f]+|[0-9A-F]+)$'))"
    none = "cast(array() AS array<struct<start:int,end:int>>)"
    df = df.withColumn("_r", F.expr(f"CASE WHEN size(_long) = 0 THEN {none} ELSE flatten(transform({classed}, c -> {pieces})) END"))
    df = df.withColumn("_u", F.expr(f"CASE WHEN size(_r) = 0 THEN {none} ELSE {_joined('_r', 'transform(_r, x -> x.end)')} END".replace("get(transform(_r, x -> x.end), i - 1)", "get(_r, i - 1).end")))
    # Places where spans begin and end, with how many entropy spans (low half) and base spans (high half) cover what follows.
    steps = "array_sort(concat(transform(_u, x -> named_struct('at', x.start, 'v', 1L)), transform(_u, x -> named_struct('at', x.end, 'v', -1L)), transform(_base, x -> named_struct('at', x.start, 'v', 4294967296L)), transform(_base, x -> named_struct('at', x.end, 'v', -4294967296L))))"
    df = df.withColumn("_v", F.expr(f"CASE WHEN size(_u) = 0 THEN cast(array() AS array<struct<at:int,v:bigint>>) ELSE {steps} END"))
    df = df.withColumn("_p", F.expr(f"CASE WHEN size(_v) = 0 THEN cast(array() AS array<struct<at:int,c:bigint>>) ELSE zip_with(_v, {_running('transform(_v, x -> x.v)')}, (x, c) -> named_struct('at', x.at, 'c', c)) END"))
    free = "filter(transform(_p, (x, i) -> named_struct('start', x.at, 'kind', 3, 'end', get(_p, i + 1).at, 'c', x.c)), x -> x.end > x.start AND x.c > 0 AND x.c < 4294967296L)"
    df = df.withColumn("_entropy", F.expr(f"transform({free}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"))
    return df.withColumn("secret_spans", F.expr(f"cast(array_sort(concat(_base, _entropy)) AS {_SPANS})")).drop("_t", "_assign", "_access", "_hex", "_long", "_base", "_r", "_u", "_v", "_p", "_entropy")


def report(found: DataFrame) -> DataFrame:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    joined = f"array_join(transform({{}}, x -> concat(get({names}, x.kind), ':', x.start, ':', x.end)), ',')"
    count = [F.expr(f"bigint(size(filter(secret_spans, x -> x.kind = {k})))").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *count, F.expr(f"sha2({joined.format('filter(secret_spans, x -> x.kind < 3)')}, 256)").alias("base_sha256"), F.expr(joined.format("secret_spans")).alias("spans")
    )


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces the spans, joined where they overlap, by a mark; rows without spans keep their text."""
    upto = _running("transform(secret_spans, x -> x.end)", "greatest(x, {})")
    joined = f"element_at(transform(array({upto}), u -> {_joined('secret_spans', 'u')}), 1)"
    begin = "CASE WHEN i = 0 THEN 0 ELSE get(r, i - 1).end END"
    by_place = f"concat(array_join(transform(r, (x, i) -> concat(substring({text}, {begin} + 1, x.start - {begin}), '{mark}')), ''), substring({text}, element_at(r, -1).end + 1))"
    ends = "concat(r, array(named_struct('start', size(c), 'end', size(c))))"
    by_character = f"array_join(transform({ends}, (x, i) -> concat(array_join(slice(c, {begin} + 1, x.start - ({begin})), ''), CASE WHEN i < size(r) THEN '{mark}' ELSE '' END)), '')"
    characters = f"element_at(transform(array(regexp_extract_all({text}, '(?s).', 0)), c -> {by_character}), 1)"
    cut = f"element_at(transform(array({joined}), r -> CASE WHEN size(r) <= {FEW} THEN {by_place} ELSE {characters} END), 1)"
    return found.withColumn(text, F.expr(f"CASE WHEN size(secret_spans) = 0 THEN {text} ELSE {cut} END")).drop("secret_spans")
