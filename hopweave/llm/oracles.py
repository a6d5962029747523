"""DuckDB SQL of the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

import re

from hopweave.llm.quality_rules import BASE, RULES
from hopweave.llm.text_stats import STOP_WORDS, SYMBOLS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_stop = "', '".join(sorted({w for line in STOP_WORDS for w in line.split()}))
_rules = " OR ".join(re.sub(r"(?<=\d)D\b", "", r.sql()) for r in RULES)

OP2 = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
k AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
  length(regexp_replace(t, '[^|]', '', 'g')) AS n_bars, len(list_filter(ws, lambda x: lower(x) IN ('{_stop}'))) AS n_stop_words FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed, NOT {BASE} AND NOT ({_rules}) AS kept FROM k"""

OP9 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
s AS (SELECT doc_id, i, CASE WHEN i + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS win, word FROM u),
h AS (SELECT doc_id, i, word, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM s),
c AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT doc_id, count(*)::BIGINT AS n_words, count(*) FILTER (gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents), b AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, width, array_to_string(ws[i : i + width - 1], ' ') AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS width, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
q AS (SELECT doc_id, width, unnest(range(1, len(ws) - width + 2)) AS i, ws FROM d, (SELECT DISTINCT width FROM p) WHERE len(ws) >= width),
h AS (SELECT doc_id, i, width, item_id FROM (SELECT doc_id, width, i, array_to_string(ws[i : i + width - 1], ' ') AS win FROM q) JOIN p USING (width, win)),
n AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _op12(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """All distances to all entries in every round; ties go to the lower entry as it is added below the distance."""
    far = "p.norm - 2 * list_dot_product(p.v, b.v) + b.norm"
    near = f"SELECT p.r, p.part, arg_min(b.entry, ({far}) * 1024 + b.entry) AS entry, min({far}) AS d FROM p JOIN {{}} b USING (part) GROUP BY 1, 2"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, v, list_dot_product(v, v) AS norm FROM (SELECT r, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS part)))",
        f"b0 AS MATERIALIZED (SELECT part, r AS entry, v, norm FROM p WHERE r < {entries})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(f'b{i}')})",
            f"m{i} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(x) / count(*)) AS x FROM (SELECT a.part, a.entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS i FROM a{i} a JOIN p USING (r, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"b{i + 1} AS MATERIALIZED (SELECT part, entry, v, list_dot_product(v, v) AS norm FROM (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, entry)))",
        ]
    steps += [
        f"z AS MATERIALIZED ({near.format(f'b{rounds}')})",
        "c AS (SELECT r, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY 1)",
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (r), h"


# CRC-32 by its table of 256 remainders, over the bytes of each distinct run of words.
OP13 = f"""WITH tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS ws FROM documents), b AS (SELECT {_PLAIN} AS ws FROM benchmark),
fd AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM d) GROUP BY 1, 2),
fb AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(ws) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM b) GROUP BY 1),
x AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM x, tab),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM fd JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM fb JOIN k USING (f) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + 10000) / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
r AS MATERIALIZED (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT
  + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, coalesce(weight, 0)::BIGINT AS weight FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)"""

ORACLE_SQL = {"op2_quality_rules": OP2, "op9_substring_dedup": OP9, "op10_decontamination": OP10, "op12_vector_codes": _op12(), "op13_importance_resampling": OP13}
