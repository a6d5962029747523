"""Extraction and reading by models: retries, pieces of passages, audits, fact filters, decomposition, plans, answers.

A provider is any picklable callable over a batch of prompts. Each round asks only for what is still missing and is
written before the next one, so a restart loses one round at most.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hopweave.functions import repair
from hopweave.functions.text import COORDINATORS, ascii_norm, hash_id, json_object, sub_questions, valid_triples
from hopweave.operators import evidence as V
from hopweave.operators.providers import Completion, complete, render

Keep = Callable[[DataFrame], DataFrame]
ANSWER_LINE = r"(?is).*\b(?:final\s+)?answer\s*:\s*([^\n]+)"


def patient(provider: Completion, attempts: int = 4, wait: float = 0.5, most: float = 30.0) -> Completion:
    """A provider that tries again after an error, waiting as long as the error's ``retry_after`` says, else twice as long
    each time with a random part; the last error is raised."""

    def run(prompts: list[str]) -> list[str]:
        for n in range(attempts):
            try:
                return provider(prompts)
            except Exception as error:
                if n == attempts - 1:
                    raise
                asked = getattr(error, "retry_after", None)
                time.sleep(min(most, float(asked) if asked is not None else wait * 2**n * (0.5 + random.random() / 2)))
        return []

    return run


def limited(df: DataFrame, at_once: int) -> DataFrame:
    """At most so many tasks call a provider at a time: as many partitions, dealt evenly."""
    return df.repartition(at_once)


def query_windows(queries: DataFrame, order: str, size: int = 8) -> DataFrame:
    """Adds ``window``: consecutive groups of at most ``size`` queries. The query set is stated and small beside passages."""
    return queries.withColumn("window", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))


def lenient_triples(triples: Column) -> Column:
    """Lists of three parts, as text, the first of equals kept; nothing else is asked of them."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def graph_triples(rows: DataFrame) -> DataFrame:
    """rows: chunk, triples. One row for each normalised triple all of whose parts hold a letter or digit."""
    parts = rows.select("chunk", F.explode(lenient_triples(F.col("triples"))).alias("t"))
    named = parts.select("chunk", *[ascii_norm(F.coalesce(F.get("t", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(("subj", "pred", "obj"))])
    return named.where("subj <> '' AND pred <> '' AND obj <> ''").distinct()


def merged_triples(*groups: Column) -> Column:
    """Valid triples of several extractions of one passage, in order, each once."""
    return valid_triples(F.concat(*[F.coalesce(g, F.array().cast("array<array<string>>")) for g in groups]))


def entity_supported(label: Column, evidence: Column) -> Column:
    """Whether the normalised label is part of the normalised evidence, at token borders or not."""
    plain = ascii_norm(label)
    return (F.length(plain) > 0) & F.contains(ascii_norm(evidence), plain)


def hidden_entity(predicate: Column, obj: Column, known: Column, prefixes: tuple[str, ...] = ("member of", "part of", "capital of", "author of", "son of", "daughter of")) -> Column:
    """A copula whose object is a relation followed by an entity that is known on its own."""
    copula = F.lower(F.trim(predicate)).isin("is", "was", "are", "were", "is a", "was a", "is the", "was the")
    told = F.transform(F.lit(list(prefixes)), lambda p: F.transform(known, lambda k: F.concat(p, F.lit(" "), F.lower(k))))
    hidden = F.array_contains(F.flatten(told), F.lower(F.trim(obj)))
    return copula & hidden


def non_atomic(question: Column) -> Column:
    """Questions for lists, truth values, comparisons or explanations, which one span cannot answer."""
    q = F.lower(F.trim(question))
    asks_truth = q.rlike(r"^(is|are|was|were|do|does|did|has|have|can|could)\b")
    return asks_truth | q.rlike(r"\b(list|all of|how many different|which of|compare|difference between|why|explain)\b") | q.rlike(r"\b(both|either|more than one)\b")


def completed(finish: Column, error: Column, items: Column, proven_empty: Column, version: Column, expected: str) -> Column:
    """A response that ended by itself, without error, under the expected contract, with items or proof of none."""
    return F.coalesce((finish == "stop") & error.isNull() & ((F.size(items) > 0) | proven_empty) & (version == expected), F.lit(False))


def _ask(df: DataFrame, provider: Completion, schema: str) -> DataFrame:
    """Adds ``parsed``: the response's JSON object, also one in a fence or surrounded by prose; null if there is none."""
    done = complete(df, provider)
    return done.withColumn("parsed", F.from_json(F.coalesce(json_object(F.col("response")).cast("string"), F.lit("")), schema)).drop("response")


def recognise(passages: DataFrame, providers: list[Completion], keep: Keep, template: str = "List the entities of: $passage") -> DataFrame:
    """passages: idx, passage. Entities of each, by the first provider of the list (each with a larger budget than the one
    before) that gives a list; status success, empty_valid or failed."""
    pending, done = passages.withColumn("prompt", render(template, passage=F.col("passage"))), None
    for n, provider in enumerate(providers):
        asked = keep(_ask(pending, provider, "struct<entities: array<string>>").withColumn("attempt", F.lit(n)))
        good = asked.where("parsed.entities IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        pending = asked.where("parsed.entities IS NULL").drop("parsed", "attempt")
        if pending.isEmpty():
            break
    rest = pending.withColumns({"parsed": F.lit(None).cast("struct<entities: array<string>>"), "attempt": F.lit(len(providers))})
    names = F.array_distinct(F.filter(F.transform(F.coalesce("parsed.entities", F.array().cast("array<string>")), lambda e: F.trim(e)), lambda e: e != ""))
    status = F.when(F.col("parsed.entities").isNull(), "failed").when(F.size(names) == 0, "empty_valid").otherwise("success")
    return done.unionByName(rest).select("idx", "passage", names.alias("entities"), status.alias("status"), "attempt")


_PIECES = "idx string, passage string, start int, end int, prompt string"


def _cut(spans: Callable[[str], list[tuple[int, int]] | None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [p or "" for p in b["passage"]]
            rows = [(i, p, s, e, p[s:e]) for i, p in zip(b["idx"], texts) for s, e in (spans(p) or [(0, len(p))])]
            yield pd.DataFrame(rows, columns=["idx", "passage", "start", "end", "prompt"])

    return run


def _halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, p, s, e, p[s:e]) for i, p, a, z in zip(b["idx"], b["passage"], b["start"], b["end"]) for s, e in repair.split_span(p, int(a), int(z)) if e > s]
        yield pd.DataFrame(rows, columns=["idx", "passage", "start", "end", "prompt"])


def extract_by_pieces(passages: DataFrame, provider: Completion, keep: Keep, spans: Callable[[str], list[tuple[int, int]] | None] = repair.windows, least: int = 48) -> DataFrame:
    """passages: idx, passage. Pieces cover each passage (windows, or source units); a piece that fails is cut in two until
    its halves would be shorter than ``least``. A passage is complete only if all its pieces are: success, empty_valid, or
    partial with what was found."""
    pending, parts = passages.select("idx", "passage").mapInPandas(_cut(spans), _PIECES), None
    while True:
        asked = keep(_ask(pending, provider, "struct<triples: array<array<string>>>"))
        splits = F.col("parsed.triples").isNull() & (F.col("end") - F.col("start") >= 2 * least)
        ended = asked.where(~splits).select("idx", "passage", "start", "end", F.col("parsed.triples").alias("triples"))
        parts = ended if parts is None else parts.unionByName(ended)
        again = asked.where(splits)
        if again.isEmpty():
            break
        pending = again.select("idx", "passage", "start", "end").mapInPandas(_halve, _PIECES)
    # A passage has few pieces: its length over ``least`` at most.
    whole = parts.groupBy("idx", "passage").agg(
        F.count_if(F.col("triples").isNull()).alias("failed"), F.count(F.lit(1)).alias("pieces"), F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "triples"))), lambda x: x["triples"]).alias("all")
    )
    found = valid_triples(F.flatten(F.filter("all", lambda t: t.isNotNull())))
    status = F.when(F.col("failed") > 0, "partial").when(F.size(found) == 0, "empty_valid").otherwise("success")
    return whole.select("idx", "passage", "pieces", "failed", found.alias("triples"), status.alias("status"))


def audit_batches(relations: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """relations: idx, ordinal, prompt. Adds ``batch``: relations of a passage in order, as many as fit the budget of
    characters by running total; one that is too long alone has a batch of its own."""
    w = Window.partitionBy("idx").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("prompt") + overhead).over(w), F.lit(0))
    return relations.withColumn("batch", F.floor(before / budget).cast("int"))


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())]))
def _entailed(sources: pd.Series, subjects: pd.Series, quotes: pd.Series) -> pd.DataFrame:
    rows = [repair.entails(s or "", a or "", q or "") for s, a, q in zip(sources, subjects, quotes)]
    return pd.DataFrame(rows, columns=["ok", "reason"])


def audit_relations(relations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """relations: idx, ordinal, passage, subj; verdicts: idx, ordinal, verdict, quote. Accepted only if entailed with a quote
    of the source that names every member of the subject."""
    both = relations.join(verdicts, ["idx", "ordinal"], "left").withColumn("seen", _entailed("passage", "subj", "quote"))
    reason = F.when(F.col("verdict").isNull(), "no_verdict").when(F.col("verdict") != "entailed", F.col("verdict")).when(~F.col("seen.ok"), F.col("seen.reason"))
    return both.select("idx", "ordinal", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("supported")).alias("reason"))


def audit_counts(audited: DataFrame) -> DataFrame:
    """Per passage how many relations were accepted and rejected, and the contradiction of none at all."""
    return audited.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.col("reason") == "no_verdict").alias("without_verdict"))


def _realigned(group: pd.DataFrame) -> pd.DataFrame:
    """Generated facts to the candidates they resemble most; a query has few candidates."""
    candidates = group.sort_values("rank")
    texts, ids = candidates["text"].tolist(), dict(zip(candidates["text"][::-1], candidates["fact"][::-1]))
    chosen = repair.closest(json.loads(group["generated"].iloc[0] or "[]"), texts)
    return pd.DataFrame([(group["query_id"].iloc[0], ids[t], i) for i, t in enumerate(chosen)], columns=["query_id", "fact", "position"])


def filter_facts(candidates: DataFrame, questions: DataFrame, provider: Completion) -> DataFrame:
    """candidates: query_id (long), fact (long), text, rank; questions: query_id, question. The facts that a model finds
    relevant, each matched to the nearest candidate, in its order. A response without a list keeps all candidates."""
    listed = candidates.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))  # few a query
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nFacts: "), F.to_json("texts"))
    asked = _ask(listed.join(questions, "query_id").select("query_id", prompt.alias("prompt"), "texts"), provider, "struct<facts: array<string>>")
    chosen = asked.select("query_id", F.to_json(F.coalesce("parsed.facts", "texts")).alias("generated"))
    return candidates.join(chosen, "query_id").groupBy("query_id").applyInPandas(_realigned, "query_id long, fact long, position int")


def decompose(questions: DataFrame, provider: Completion, at_most: int = 3, hints: str | None = None) -> DataFrame:
    """questions: query_id, question (and hints). (query_id, ordinal, sub_question): lines of the response that say more than
    the question; the question itself where none is left."""
    prompt = F.concat(F.lit("Decompose: "), "question", *([F.lit("\nHints: "), F.coalesce(F.col(hints), F.lit(""))] if hints else []))
    lines = complete(questions.select("query_id", "question", prompt.alias("prompt")), provider).withColumn("subs", sub_questions(F.col("response"), at_most))
    useful = F.filter("subs", lambda s: (F.length(s) >= 4) & (ascii_norm(s) != ascii_norm(F.col("question"))))
    return lines.select("query_id", F.posexplode(F.when(F.size(useful) > 0, useful).otherwise(F.array("question"))).alias("ordinal", "sub_question"))


def plan_questions(questions: DataFrame, provider: Completion, keep: Keep, most_nodes: int = 6, attempts: int = 2) -> DataFrame:
    """questions: plan_id, question. Nodes (plan_id, id, question, depends_on) of plans without a fault; a faulty one is
    asked for again with its first fault named. Plans that stay faulty are left out."""
    pending, done = questions.select("plan_id", "question", F.concat(F.lit("Plan: "), "question").alias("prompt")), None
    for _ in range(attempts):
        asked = keep(_ask(pending, provider, "struct<nodes: array<struct<id: string, question: string, depends_on: array<string>>>>"))
        nodes = asked.where("size(parsed.nodes) > 0").select("plan_id", F.explode("parsed.nodes").alias("n")).select("plan_id", "n.id", "n.question", F.coalesce("n.depends_on", F.array().cast("array<string>")).alias("depends_on"))
        row_faults = V.plan_issues(nodes, most_nodes).where("reason IS NOT NULL").groupBy("plan_id").agg(F.min("reason").alias("reason"))
        cycles = V.plan_depths(nodes, keep).groupBy("plan_id").agg(F.max(F.col("depth").isNull()).alias("cyclic"), F.max("depth").alias("depth"))
        judged = keep(asked.select("plan_id", "question").join(row_faults, "plan_id", "left").join(cycles, "plan_id", "left").withColumn(
            "fault", F.when(F.col("cyclic").isNull(), "no_plan").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("cyclic"), "cycle")
        ))
        good = nodes.join(judged.where("fault IS NULL").select("plan_id"), "plan_id", "left_semi")
        done = good if done is None else done.unionByName(good)
        pending = judged.where("fault IS NOT NULL").select("plan_id", "question", F.concat(F.lit("Plan: "), "question", F.lit("\nFault: "), "fault").alias("prompt"))
        if pending.isEmpty():
            break
    return done


def as_text(value: Column) -> Column:
    """A response part (a variant, or text) as text: strings as they are, lists by lines, null as empty."""
    listed = F.try_variant_get(value, "$", "array<string>")
    return F.coalesce(F.array_join(listed, "\n"), F.try_variant_get(value, "$", "string"), F.lit(""))


def decode_escapes(text: Column) -> Column:
    """Literal \\uXXXX sequences, also pairs of surrogates, as characters; text without any stays as it is."""
    pairs = r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pairs), F.lit(1)))
    character = lambda e: F.decode(F.unhex(F.replace(e, F.lit("\\u"), F.lit(""))), "UTF-16BE")
    return F.aggregate(found, text, lambda done, e: F.replace(done, e, character(e)))


def answer_of(response: Column) -> Column:
    """The answer field of a JSON object, else what follows the last "answer:", else the last line that is not empty."""
    field = F.try_variant_get(json_object(response), "$.answer", "string")
    marked = F.nullif(F.trim(F.regexp_extract(response, ANSWER_LINE, 1)), F.lit(""))
    lines = F.filter(F.transform(F.split(response, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.nullif(F.trim(field), F.lit("")), marked, F.try_element_at(lines, F.lit(-1)), F.lit(""))


def n_tokens(text: Column) -> Column:
    """Words and marks: a stand-in for a tokenizer's count."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def answer_questions(questions: DataFrame, ranked: DataFrame, texts: DataFrame, provider: Completion, passages: int = 5) -> DataFrame:
    """questions: query_id, question; ranked: query_id, passage, rank; texts: passage, text. (query_id, answer, response) from
    a prompt with the first passages in order."""
    first = ranked.where(F.col("rank") <= passages).join(texts, "passage")
    held = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))  # at most ``passages`` a query
    prompt = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question", F.lit("\nThought: "))
    done = complete(questions.join(held, "query_id", "left").select("query_id", prompt.alias("prompt")), provider)
    return done.select("query_id", answer_of(F.col("response")).alias("answer"), "response")


def reasoning_prompt(question: Column, passages: Column, thoughts: Column) -> Column:
    """The prompt of the next step of interleaved reasoning."""
    return F.concat(F.array_join(passages, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nThought: "), F.array_join(thoughts, " "))


def coordinated(predicate: Column) -> Column:
    """Predicates that only join: no relation."""
    return F.lower(F.trim(predicate)).isin(*COORDINATORS)


def chunk_ids(passages: DataFrame) -> DataFrame:
    """idx and passage of distinct texts."""
    return passages.select(hash_id("chunk", F.col("passage")).alias("idx"), "passage").dropDuplicates(["idx"])
