"""Text predicates, parsers and evidence checks over documents, benchmark, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hopweave.functions import grammar, numeric as N
from hopweave.functions import routing, text as X
from hopweave.operators import evidence as V
from hopweave.operators import ranking as R
from hopweave.plans.registry import query
from hopweave.sources.shared import keep, spread
from hopweave.sources.tables import complete_gold, keep_first, table

ASCII = "trim(regexp_replace(lower({0}), '[^A-Za-z0-9 ]', ' ', 'g'))"
UNICODE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', ' ', 'g'), '\s+', ' ', 'g'))"
EVIDENCE = r"array_to_string(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}_]+)', 1), ' ')"
SURFACE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~"
_BARE = rf"translate(lower({{0}}), '{_PUNCT}', '')"
ANSWER = rf"coalesce(array_to_string(list_filter(regexp_split_to_array({_BARE}, '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' '), '')"


MOST_KEYS = 10_000  # of a stated set that go along with a plan


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _few(keys: DataFrame) -> list[str] | None:
    """The distinct keys of one column, sorted; None where they are too many to go along with a plan."""
    found = sorted(r[0] for r in keys.distinct().limit(MOST_KEYS + 1).collect())
    return found if len(found) <= MOST_KEYS else None


@query(f"SELECT doc_id, md5({ASCII.format('text')}) AS ascii, md5({UNICODE.format('text')}) AS unicode, md5({EVIDENCE.format('text')}) AS evidence, md5({SURFACE.format('text')}) AS surface FROM documents")
def normalisers(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(X.ascii_norm(t)).alias("ascii"), F.md5(X.unicode_norm(t)).alias("unicode"), F.md5(X.evidence_norm(t)).alias("evidence"), F.md5(X.surface_norm(t)).alias("surface"))


@query(f"SELECT item_id, {ANSWER.format('text')} AS answer FROM benchmark")
def norm_answer_benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.answer_norm(F.col("text")).alias("answer"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' AND NOT x LIKE '%ss' AND NOT x LIKE '%us' THEN left(x, length(x) - 1) ELSE x END), 'string_agg', ' ') AS stems, length(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) <= 2 AS short FROM part")
def stems_and_short_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.split(F.lower("p_name"), " "), X.plural_stem), " ").alias("stems"), X.short_label(F.col("p_brand")).alias("short"))


_TURNS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


def user_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def _classes_sql(classes, otherwise):
    text = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in classes) + f" ELSE '{otherwise}' END"


@query(f"SELECT conv_id, turn, {_classes_sql(X.STRUCTURE_CLASSES, 'other_relation')} AS structure, {_classes_sql(X.TERMINAL_CLASSES, 'other')} AS attribute FROM ({_TURNS})")
def question_classes(spark, sf_dir):
    return user_turns(spark, sf_dir).select("conv_id", "turn", X.question_structure(F.col("text")).alias("structure"), X.terminal_attribute(F.col("text")).alias("attribute"))


_CUES = " + ".join(f"contains(' ' || lower(text) || ' ', ' {c} ')::INT" for c in X.HOP_CUES)


@query(f"SELECT doc_id, n::INT AS cues, CASE WHEN n <= 1 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END::INT AS hops, CASE WHEN n >= 5 THEN '5+' ELSE n::VARCHAR END AS bucket FROM (SELECT doc_id, {_CUES} AS n FROM documents)")
def hop_keywords(spark, sf_dir):
    n = X.hop_keywords(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n.alias("cues"), X.keyword_hops(F.col("text")).alias("hops"), X.bucket_hops(n).alias("bucket"))


@query(
    """SELECT doc_id, title, CASE WHEN pl > 0 THEN substring(text, greatest(1, pl - 160)::INT, (pl - greatest(1, pl - 160) + 3 + 240)::INT) ELSE substring(text, 1, 400) END AS snippet
    FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS title, strpos(lower(text), 'the') AS pl FROM documents)"""
)
def title_snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.first_line(F.col("text")).alias("title"), X.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bit\b', 'A$1 \ x', 'g'), '(?i)\bthis\b', 'A$1 \ x', 'g'), '(?i)\bthat\b', 'A$1 \ x', 'g'), '(?i)\bthese\b', 'A$1 \ x', 'g'), '(?i)\bthose\b', 'A$1 \ x', 'g'), '(?i)\bthe same\b', 'A$1 \ x', 'g'), '(?i)\bsame one\b', 'A$1 \ x', 'g'), '(?i)\bsame entity\b', 'A$1 \ x', 'g') AS question FROM conversations".replace(r"\ x", r"\\ x"))
def anchor_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.rewrite_anaphora(F.col("text"), "A$1 \\ x").alias("question"))


@query(
    f"""WITH b AS (SELECT item_id, {SURFACE.format('list_filter(string_split(text, chr(10)), lambda x: trim(x) <> $$$$)[1]')} AS phrase FROM benchmark), d AS (SELECT doc_id, {SURFACE.format('text')} AS body FROM documents)
    SELECT item_id, doc_id FROM b JOIN d ON length(phrase) > 0 AND contains(' ' || body || ' ', ' ' || phrase || ' ')"""
)
def phrase_containment(spark, sf_dir):
    """Which documents hold the first line of an item, token by token. Items are the stated query set; only pairs that
    share a run of four words, or the rarest word of a shorter phrase, meet."""
    items = table(spark, sf_dir, "benchmark").select("item_id", X.surface_norm(X.first_line(F.col("text"))).alias("phrase")).where("phrase <> ''")
    body = docs(spark, sf_dir).select("doc_id", X.surface_norm(F.col("text")).alias("body")).withColumn("w", F.split("body", " "))
    phrases = items.select("phrase").distinct().withColumn("w", F.split("phrase", " "))
    runs = phrases.where(F.size("w") >= 4).select("phrase", F.array_join(F.slice("w", 1, 4), " ").alias("g"))
    # A shorter phrase goes by its rarest word, so that frequent words are no keys.
    words = phrases.where(F.size("w") < 4).select("phrase", F.explode(F.array_distinct("w")).alias("g"))
    short = _few(words.select("g"))
    rarest = words.select("phrase", "g", F.lit(0).alias("df"))
    if short is None or short:
        met = F.array_distinct("w" if short is None else F.filter("w", lambda g: g.isin(short)))
        held = body.select(F.explode(met).alias("g")).join(words.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        rarest = words.join(held, "g")
    rarest = rarest.groupBy("phrase").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    keys = keep(runs.unionByName(rarest))
    # The words are a column of their own: inside a lambda an expression would run again for each element.
    gram = lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2), F.get("w", i + 3))
    listed = _few(keys.select("g"))
    if listed is None:
        grams = F.transform(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 3)), gram)
        parts = body.select("doc_id", F.explode(F.array_union(grams, F.col("w"))).alias("g"))
        met = parts.join(keys, "g").select("doc_id", "phrase").distinct()  # only rows of keys go on, without texts
        found = met.join(body, "doc_id").where(X.contains_phrase(F.col("phrase"), F.col("body")))
    else:  # few keys: a run is made only where its first word is one's, and a text meets them where it was read
        long, single = ([g for g in listed if (" " in g) == many] for many in (True, False))
        first = F.transform("w", lambda x, i: F.when(x.isin(sorted({g.split(" ")[0] for g in long})), gram(x, i)))
        own = [F.filter(first, lambda g: g.isin(long))] * bool(long) + [F.filter("w", lambda g: g.isin(single))] * bool(single)
        if not own:
            return items.join(body, F.lit(False)).select("item_id", "doc_id")
        parts = body.select("doc_id", "body", F.explode(F.array_distinct(F.concat(*own))).alias("g"))
        found = parts.join(F.broadcast(keys), "g").where(X.contains_phrase(F.col("phrase"), F.col("body")))
    return found.select("doc_id", "phrase").join(items, "phrase").select("item_id", "doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split({SURFACE.format('text')}, ' '), lambda x: x <> '')) AS w, source FROM documents)
    SELECT a.doc_id, b.doc_id AS other, round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w)))), 6) AS jaccard FROM t a JOIN t b ON a.source = b.source AND b.doc_id = a.doc_id + 20"""
)
def jaccard_docs(spark, sf_dir):
    """Token Jaccard of neighbouring documents of a source."""
    t = docs(spark, sf_dir).select("doc_id", "source", F.array_distinct(X.tokens(X.surface_norm(F.col("text")))).alias("w"))
    other = t.select((F.col("doc_id") - 20).alias("doc_id"), "source", F.col("doc_id").alias("other"), F.col("w").alias("v"))
    return t.join(other, ["doc_id", "source"]).select("doc_id", "other", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query(
    f"""WITH h AS (SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'unknown' WHEN doc_id % 7 = 2 THEN 'zzz' ELSE split_part(trim(string_split(text, chr(10))[1]), ' ', 2) END AS answer,
      CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 7) WHEN doc_id % 5 = 1 THEN 'unknown ' || text ELSE string_split(text, chr(10))[1] END AS evidence, CASE WHEN doc_id % 13 = 0 THEN 'nan' WHEN doc_id % 13 = 1 THEN '0.1' ELSE '0.9' END AS confidence FROM documents),
    c AS (SELECT h.*, d.text, CASE WHEN confidence = 'nan' THEN 0.0 ELSE confidence::DOUBLE END AS claimed, trim(answer) AS a, trim(evidence) AS q FROM h LEFT JOIN documents d USING (doc_id))
    SELECT doc_id, answer, claimed, CASE WHEN text IS NULL THEN 'unknown_document_reference' WHEN length(a) = 0 OR length(a) > 200 THEN 'invalid_answer_or_hash' WHEN length(q) < 8 OR length(q) > 1500 OR NOT contains(text, q) THEN 'evidence_not_exact_substring'
      WHEN NOT contains({EVIDENCE.format('q')}, {EVIDENCE.format('a')}) THEN 'answer_not_supported_in_quote' WHEN {EVIDENCE.format('a')} IN ('unknown', 'none', 'not known', 'not stated', 'no answer') THEN 'missing_answer' WHEN claimed < 0.25 THEN 'low_claimed_confidence' END AS reason FROM c"""
)
def quote_grounding_reasons(spark, sf_dir):
    m = lambda k: F.col("doc_id") % k
    d = docs(spark, sf_dir)
    h = d.select(
        (F.col("doc_id") + F.when(m(11) == 0, 1000000).otherwise(0)).alias("doc_id"),
        F.when(m(7) == 0, "").when(m(7) == 1, "unknown").when(m(7) == 2, "zzz").otherwise(F.split_part(F.trim(F.get(F.split("text", "\n"), F.lit(0))), F.lit(" "), F.lit(2))).alias("answer"),
        F.when(m(5) == 0, F.substring("text", 1, 7)).when(m(5) == 1, F.concat(F.lit("unknown "), "text")).otherwise(F.get(F.split("text", "\n"), F.lit(0))).alias("evidence"),
        F.when(m(13) == 0, "nan").when(m(13) == 1, "0.1").otherwise("0.9").alias("confidence"),
    )
    return V.hypothesis_reasons(h, d).select("doc_id", "answer", "claimed", "reason")


@query("SELECT doc_id, answer, evidence, coalesce(ok, false) AS ok FROM (SELECT doc_id, lang AS answer, source AS evidence FROM documents) LEFT JOIN (SELECT doc_id, lang AS answer, source AS evidence, bool_and(quality = 1 AND toxic = 0) AS ok FROM labels JOIN documents USING (doc_id) GROUP BY ALL) USING (doc_id, answer, evidence)")
def relation_verdicts(spark, sf_dir):
    h = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("answer"), F.col("source").alias("evidence"))
    v = table(spark, sf_dir, "labels").join(h, "doc_id").select("doc_id", "answer", "evidence", F.when(F.col("quality") == 1, "entailed").otherwise("refuted").alias("verdict"), (F.col("toxic") == 0).alias("relation_supported"))
    return V.relation_verdicts(h, v).select("doc_id", "answer", "evidence", "ok")


@query(
    r"""WITH t AS (SELECT event_id, [[' ' || event_type || ' ', CASE WHEN event_id % 5 = 0 THEN ' and ' ELSE 'made by' END, 'user ' || user_id], [event_type, CASE WHEN event_id % 5 = 0 THEN 'And' ELSE 'made by' END, 'user ' || user_id], [event_type, '--', 'x'], [event_type]] AS triples FROM events)
    SELECT event_id, (CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END)::INT AS n_valid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE trim(triples[1][1]) || '|' || triples[1][2] || '|' || triples[1][3] END AS first FROM t"""
)
def triple_validity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user, kind = F.concat(F.lit("user "), F.col("user_id")), F.col("event_type")
    odd = F.col("event_id") % 5 == 0
    made = lambda word: F.when(odd, word).otherwise("made by")
    raw = F.array(F.array(F.concat(F.lit(" "), kind, F.lit(" ")), made(" and "), user), F.array(kind, made("And"), user), F.array(kind, F.lit("--"), F.lit("x")), F.array(kind))
    return e.select("event_id", X.valid_triples(raw).alias("v")).select("event_id", F.size("v").alias("n_valid"), F.array_join(F.get("v", F.lit(0)), "|").alias("first"))


@query("SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, -1) AS k FROM events")
def json_objects(spark, sf_dir):
    """Objects found in text around them."""
    raw = F.concat(F.lit("noise "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(X.json_object(raw), "$.k", "bigint"), F.lit(-1)).alias("k"))


@query("SELECT conv_id, turn, trim(role || ' ' || turn) AS field, text AS answer FROM conversations WHERE NOT contains(text, '[[') AND text = trim(text)")
def json_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("NOT contains(text, '[[') AND text = trim(text)")
    response = F.concat(F.lit("[[ ## field ## ]]\n"), "role", F.lit(" "), "turn", F.lit(" \n[[ ## answer ## ]] "), "text", F.lit("\n[[ ## completed ## ]]"))
    return c.select("conv_id", "turn", F.trim(X.section(response, "field")).alias("field"), X.section(response, "answer").alias("answer"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN 'Who rules ' || n_name || ' in ' || r_name || '?' END AS question FROM nation JOIN region ON n_regionkey = r_regionkey")
def placeholder_binding(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bound = F.when(F.col("n_nationkey") % 5 == 0, F.create_map(F.lit("s1"), "n_name")).otherwise(F.create_map(F.lit("s1"), "n_name", F.lit("s2"), "r_name"))
    return both.select("n_nationkey", X.bind_placeholders(F.lit("Who rules ${s1.answer} in ${s2.answer}?"), bound).alias("question"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS matches FROM customer")
def branch_compatibility(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    need = F.create_map(F.lit("segment"), F.lit("Building!"))
    return c.select("c_custkey", X.branch_matches(need, F.create_map(F.lit("segment"), "c_mktsegment", F.lit("id"), F.col("c_custkey").cast("string"))).alias("matches"))


@query(r"""SELECT page_id, array_to_string(list_distinct(regexp_extract_all(html, '\b((?:18|19|20)\d\d)\b', 1)), ',') IS NOT NULL AS has, len(list_distinct(regexp_extract_all(html, '\b((?:18|19|20)\d\d)\b', 1)))::INT AS n_years FROM pages""")
def text_years(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lit(True).alias("has"), F.size(X.years(F.col("html"))).alias("n_years"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: x <> ''))::INT AS n_units FROM documents""")
def source_units(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(X.sentences(F.regexp_replace("text", r"([.!?])\s+", "$1\n"))).alias("n_units"))


@query("SELECT item_id, list_distinct(list_concat(w, list_concat(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END))).len()::INT AS n_grams FROM (SELECT item_id, list_filter(string_split(" + SURFACE.format("text") + ", ' '), lambda x: x <> '') AS w FROM benchmark)")
def token_ngrams(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", X.tokens(X.surface_norm(F.col("text"))).alias("w"))
    return words.select("item_id", F.size(X.ngrams(F.col("w"), 3)).alias("n_grams"))


@query("SELECT c_custkey, lower(c_mktsegment) IN ('yes', 'true', 't', 'y', '1') AS flag, CASE WHEN c_custkey % 3 = 0 THEN 0.5 WHEN c_custkey % 3 = 1 THEN 0.5 ELSE c_acctbal END AS value FROM customer")
def safe_casts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, "nan").when(F.col("c_custkey") % 3 == 1, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", X.parse_bool(F.col("c_mktsegment")).alias("flag"), X.finite(raw, 0.5).alias("value"))


@query("SELECT o_orderkey, round(CASE WHEN n = 0 THEN 0 ELSE 0.45 * least_q + 0.35 * mean_q + 0.20 * n / greatest(1, total) END, 6) AS score FROM (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(min(l_discount), 0) AS least_q, coalesce(avg(l_discount), 0) AS mean_q, 7 AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def beam_scores(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.collect_list("l_discount").alias("q")).select("o_orderkey", F.round(N.beam_score(F.col("q"), F.lit(7)), 6).alias("score"))


# Plans: parts of an order line chain, a deterministic graph: line k depends on lines k-1 and k-3 of its order.
_NODES = "nodes AS (SELECT DISTINCT l_orderkey AS plan_id, 's' || l_linenumber AS id, l_linenumber AS n FROM lineitem)"
_EDGES = f"{_NODES}, edges AS (SELECT a.plan_id, a.id, b.id AS dep FROM nodes a JOIN nodes b ON a.plan_id = b.plan_id AND b.n IN (a.n - 1, a.n - 3))"


def _plans(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("n")).distinct()
    have = n.groupBy("plan_id").agg(F.collect_set("n").alias("all"))  # at most seven lines
    deps = F.transform(F.filter(F.array(F.col("n") - 1, F.col("n") - 3), lambda k: F.array_contains("all", k)), lambda k: F.concat(F.lit("s"), k))
    return n.join(have, "plan_id").select("plan_id", F.concat(F.lit("s"), "n").alias("id"), deps.alias("depends_on"))


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT plan_id, id, 0 AS depth FROM nodes WHERE (plan_id, id) NOT IN (SELECT (plan_id, id) FROM edges) UNION ALL SELECT e.plan_id, e.id, w.depth + 1 FROM walk w JOIN edges e ON e.plan_id = w.plan_id AND e.dep = w.id) SELECT plan_id, id, max(depth)::INT AS depth FROM walk GROUP BY ALL")
def dag_layers(spark, sf_dir):
    return V.plan_depths(_plans(spark, sf_dir), keep)


@query(f"WITH RECURSIVE {_EDGES}, up AS (SELECT plan_id, id, dep AS ancestor FROM edges UNION SELECT u.plan_id, u.id, e.dep FROM up u JOIN edges e ON e.plan_id = u.plan_id AND e.id = u.ancestor) SELECT DISTINCT plan_id, id, ancestor FROM up")
def dag_ancestors(spark, sf_dir):
    return V.ancestors(_plans(spark, sf_dir), keep)


@query("SELECT n_nationkey::BIGINT AS plan_id, id, CASE WHEN n_nationkey % 4 = 1 AND id = 's2' THEN 'dependency_reference_mismatch' WHEN n_nationkey % 4 = 2 AND id = '9x' THEN 'invalid_node_id' WHEN n_nationkey % 4 = 3 AND id = 's2' THEN 'unknown_or_self_dependency' END AS reason FROM nation, (SELECT unnest(['s1', 's2']) AS k) CROSS JOIN LATERAL (SELECT CASE WHEN n_nationkey % 4 = 2 AND k = 's1' THEN '9x' ELSE k END AS id)")
def plan_validity(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("m", F.col("n_nationkey") % 4)
    first = n.select(F.col("n_nationkey").cast("long").alias("plan_id"), F.when(F.col("m") == 2, "9x").otherwise("s1").alias("id"), F.lit("Who rules it?").alias("question"), F.array().cast("array<string>").alias("depends_on"))
    ref = F.when(F.col("m") == 3, "s7").when(F.col("m") == 2, "9x").otherwise("s1")
    question = F.when(F.col("m") == 1, "Who is that?").when(F.col("m") == 3, "Where is ${s7.answer}?").when(F.col("m") == 2, "Where?").otherwise("Where is ${s1.answer}?")
    deps = F.when(F.col("m") == 2, F.array().cast("array<string>")).otherwise(F.array(ref))
    second = n.select(F.col("n_nationkey").cast("long").alias("plan_id"), F.lit("s2").alias("id"), question.alias("question"), deps.alias("depends_on"))
    return V.plan_issues(first.unionByName(second))


@query("WITH p AS (SELECT o_orderkey, count(*) AS n FROM (SELECT DISTINCT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1), m AS (SELECT o_orderkey AS plan_id, n, unnest(range(1, (1 << n)::BIGINT)) AS mask FROM p) SELECT plan_id, mask::INT AS mask, bit_count(mask)::INT AS size FROM m WHERE (mask & (mask + 1)) = 0")
def closed_subsets(spark, sf_dir):
    """Ancestor-closed node sets of chains: their prefixes."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), "l_linenumber").distinct().groupBy("plan_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"))
    parents = F.expr("transform(sequence(0, n - 1), i -> CASE WHEN i = 0 THEN 0 ELSE int(shiftleft(1, i - 1)) END)")
    return V.closed_subsets(lines.join(orders, "plan_id").withColumn("parents", parents)).select("plan_id", F.col("mask").cast("int").alias("mask"), F.col("size").cast("int").alias("size"))


@query("SELECT l_orderkey AS query_id, l_partkey AS removed, l_suppkey AS added, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS vetoed FROM lineitem")
def support_guard(spark, sf_dir):
    swaps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("removed"), F.col("l_suppkey").alias("added"))
    protected = swaps.join(table(spark, sf_dir, "part").where("p_size > 25"), F.col("removed") == F.col("p_partkey"), "left_semi").select("query_id", F.col("removed").alias("passage"))
    return V.support_guard(swaps, protected).select("query_id", "removed", "added", "vetoed")


@query("SELECT text AS passage FROM (SELECT DISTINCT text FROM documents) UNION ALL SELECT DISTINCT text FROM benchmark WHERE text NOT IN (SELECT text FROM documents)")
def gold_completion(spark, sf_dir):
    return complete_gold(docs(spark, sf_dir).select(F.col("text").alias("passage")).distinct(), table(spark, sf_dir, "benchmark").select(F.col("text").alias("passage")))


@query("SELECT md5(text) AS idx, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text")
def keep_first_and_last(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.md5("text").alias("idx"), "doc_id")
    first, last = keep_first(d, ["idx"], ["doc_id"]), keep_first(d, ["idx"], [F.desc("doc_id")])
    return first.withColumnRenamed("doc_id", "first_id").join(last.withColumnRenamed("doc_id", "last_id"), "idx")


@query("SELECT p.doc_id, CASE WHEN l.doc_id IS NULL THEN p.quality ELSE l.quality END AS quality, l.doc_id IS NOT NULL AS overlaid FROM (SELECT doc_id, -1 AS quality FROM documents) p LEFT JOIN labels l USING (doc_id)")
def checkpoint_overlay(spark, sf_dir):
    """Checkpoint rows override base rows of the same key."""
    base = docs(spark, sf_dir).select("doc_id", F.lit(-1).alias("quality"))
    done = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("new"), F.lit(True).alias("hit"))
    return base.join(done, "doc_id", "left").select("doc_id", F.coalesce("new", "quality").alias("quality"), F.coalesce("hit", F.lit(False)).alias("overlaid"))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_invariants(spark, sf_dir):
    return R.same_sets(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").intersect(docs(spark, sf_dir).select("doc_id")), ["doc_id"])


@query("SELECT title, count(*)::BIGINT AS n, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS merged FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS title FROM documents) GROUP BY title")
def merge_same_title(spark, sf_dir):
    t = docs(spark, sf_dir).select(X.first_line(F.col("text")).alias("title"), "doc_id", "text")
    grouped = t.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("all"))
    return grouped.select("title", "n", F.sha2(F.array_join(F.transform("all", lambda x: x["text"]), "\n"), 256).alias("merged"))


@query("SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY ALL")
def sessionised_events(spark, sf_dir):
    """Our addition: sessions of events by a gap of half an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    gap = F.unix_micros("ts") / 1e6 - F.lag(F.unix_micros("ts") / 1e6).over(w) if str(e.schema["ts"].dataType) != "TimestampNTZType()" else F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lag(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).over(w)
    marked = e.withColumn("new", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Questions of known shapes about customers, their nations and the parts of a number: (shape, route of two hops, text).
_SHAPES = (
    ("parallel_comparison", "parallel_comparison", "Which is larger, Customer {a} or {b}?"),
    ("parallel_comparison", "parallel_comparison", "Do Customer {a} and {b} share a border?"),
    ("bridge_comparison", "bridge_comparison", "Are the founders of Customer {a} and {b} the same age?"),
    ("bridge_comparison", "bridge_comparison", "Which firm whose owner is older opened first, Customer {a} or {b}?"),
    ("parallel_attribute", "parallel_attribute", "When were Customer {a} and {b} founded?"),
    ("chain_or_unknown", "nested_bridge", "Where was the founder of Customer {a} in {b} born?"),
    ("chain_or_unknown", "chain_or_unknown", "When did Customer {a} come to {b}?"),
    ("chain_or_unknown", "chain_or_unknown", "Did Customer {a} and {b} trade in the same year as Europe?"),
)
_CASES = lambda k: "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{s[k]}'" for i, s in enumerate(_SHAPES)) + " END"


@query(f"SELECT c_custkey, {_CASES(0)} AS shape, {_CASES(1)} AS shallow, CASE WHEN c_custkey % 8 >= 5 THEN 'dependency_chain' ELSE {_CASES(0)} END AS deep FROM customer JOIN nation ON c_nationkey = n_nationkey")
def question_routes(spark, sf_dir):
    """Each customer asked about in one of eight ways; the SQL knows the shape from the way, not from the words."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = F.array(*[F.format_string(t.replace("{a}", "%s").replace("{b}", "%s"), F.col("c_custkey").cast("string"), F.initcap("n_name")) for _, _, t in _SHAPES])
    # A question takes far longer than its row: the rows are dealt out first, each line of marks is made once.
    lines = spread(c.select("c_custkey", "n_name"), "c_custkey").select("c_custkey", routing.marks(F.get(kinds, F.col("c_custkey").cast("int") % 8)).alias("line"))
    read = lines.select("c_custkey", routing.shape(F.col("line")).alias("shape"), routing.describes(F.col("line")).alias("told"))
    return read.select("c_custkey", "shape", *[routing.routed(F.col("shape"), F.col("told"), F.lit(n)).alias(name) for name, n in (("shallow", 2), ("deep", 3))])


@query(
    """SELECT c_custkey AS claim_id, 'residence' AS relation, 'Customer ' || c_custkey AS subject, CASE c_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'unknown' ELSE 'contradicted' END AS status,
    CASE c_custkey % 4 WHEN 0 THEN 'form' WHEN 1 THEN 'other_value' WHEN 2 THEN 'negated' ELSE 'other_direction' END AS reason FROM customer"""
)
def relation_checks(spark, sf_dir):
    """Claims on where customers live, against texts that say so, name another nation, deny it, or turn it round."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = spread(c.select("c_custkey", "n_name"), "c_custkey")  # a claim takes far longer than its row
    who, kind = F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")), F.col("c_custkey") % 4
    said = F.when(kind == 0, F.concat(who, F.lit(", a buyer, lives in "), "n_name")).when(kind == 1, F.concat(who, F.lit(" lives in Nowhere"))).when(kind == 2, F.concat(who, F.lit(" never lived in "), "n_name")).otherwise(F.concat("n_name", F.lit(" lives in "), who))
    claims = c.select(F.col("c_custkey").alias("claim_id"), F.concat(F.lit("Where does "), who, F.lit(" live?")).alias("question"), F.col("n_name").alias("answer"), F.concat(F.lit("Some words first. "), said, F.lit(". More words.")).alias("text"))
    return grammar.check(claims)
