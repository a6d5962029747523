"""What follows a first pass over evidence: more documents where none convinced, typed answers, witnesses, repaired plans."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hopweave.functions import relations
from hopweave.functions.text import contains_phrase, evidence_norm
from hopweave.operators.extraction import _ask
from hopweave.operators.providers import Completion, complete
from hopweave.sources.shared import keep
from hopweave.sources.stores import Versioned

Keep = Callable[[DataFrame], DataFrame]
VERDICT = "struct<answer: string, evidence: string, confidence: double>"
#: What each ablation mode runs, in order.
MODES = {
    "budget_dag": ("plan", "search", "verify"), "budget_qd": ("decompose", "verify"), "budget_iterative": ("search", "second_round", "verify"),
    "fixed_pool": ("verify", "select"), "validation": ("verify",), "selection": ("select",),
}


def verify_documents(ranked: DataFrame, provider: Completion) -> DataFrame:
    """ranked: query_id, question, passage, text, rank. One hypothesis of each document, where the response holds one."""
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nDocument: "), "text")
    asked = _ask(ranked.withColumn("prompt", prompt), provider, VERDICT)
    return asked.where("parsed.answer <> ''").select("query_id", "passage", "rank", "parsed.answer", "parsed.evidence", "parsed.confidence")


def verify_in_steps(ranked: DataFrame, provider: Completion, accepted: Callable[[DataFrame], DataFrame], keep: Keep, step: int = 3, steps: int = 2) -> DataFrame:
    """The first ``step`` documents of each query; only queries without an accepted hypothesis get the next ones."""
    done, pending = None, ranked
    for n in range(steps):
        found = keep(accepted(verify_documents(pending.where(F.col("rank").between(n * step + 1, (n + 1) * step)), provider)))
        done = found if done is None else done.unionByName(found)
        pending = pending.join(done.select("query_id").distinct(), "query_id", "left_anti")
    return done


def ambiguous(beams: DataFrame, gap: float = 0.06) -> DataFrame:
    """beams: query_id, beam_id, score. The best beam of each query, and the second one where it is hardly worse."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "beam_id")
    ranked = beams.withColumns({"place": F.row_number().over(w), "best": F.first("score").over(w)})
    return ranked.where((F.col("place") == 1) | ((F.col("place") == 2) & (F.col("best") - F.col("score") <= gap))).drop("best")


def type_reason(answer: Column, answer_type: Column) -> Column:
    """Why an answer cannot be of its type, if so; the rules of relations.typed_reason as one expression."""
    said, kind = F.coalesce(answer, F.lit("")), F.lower(F.trim(F.coalesce(answer_type, F.lit(""))))
    number = said.rlike(r"\d") | said.rlike(r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten)\b")
    return (
        F.when(kind.isin("date", "year", "time") & ~said.rlike(r"\d"), "not_a_time").when(kind.isin("number", "count", "quantity") & ~number, "not_a_number")
        .when(kind.isin("person", "place", "location", "city", "country") & said.rlike(r"^[\d\W]+$"), "not_a_name")
    )


def typed(hypotheses: DataFrame) -> DataFrame:
    """hypotheses: answer, answer_type, ... Adds ``type_reason``, why the answer cannot be of its type; null if it can."""
    return hypotheses.withColumn("type_reason", type_reason(F.col("answer"), F.col("answer_type")))


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def _witness(questions: pd.Series, answers: pd.Series, quotes: pd.Series, documents: pd.Series) -> pd.DataFrame:
    rows = [relations.witness(q or "", a or "", e or "", d or "") for q, a, e, d in zip(questions, answers, quotes, documents)]
    return pd.DataFrame(rows, columns=["status", "reason", "start", "end"])


def witnessed(hypotheses: DataFrame, documents: DataFrame) -> DataFrame:
    """hypotheses: question, answer, evidence, passage; documents: passage, text. Contradicted ones go; a quote that differs
    from its place in the source by marks or spaces is replaced by what stands there. Adds ``witness`` (status)."""
    seen = hypotheses.join(documents, "passage").withColumn("w", _witness("question", "answer", "evidence", "text")).where("w.status <> 'contradicted'")
    literal = F.when((F.col("w.start") >= 0) & ~F.contains("text", "evidence"), F.expr("substring(text, w.start + 1, w.end - w.start)")).otherwise(F.col("evidence"))
    return seen.withColumn("evidence", literal).select(*hypotheses.columns, F.col("w.status").alias("witness"))


def plan_signature(nodes: DataFrame) -> DataFrame:
    """(plan_id, signature): the same for plans whose normalised questions and dependencies agree, whatever their order."""
    line = F.concat_ws("|", evidence_norm(F.col("question")), F.array_join(F.array_sort("depends_on"), ","))
    return nodes.groupBy("plan_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"))  # a plan has few nodes


MEMO = "key string, response string"


def verdict_key(*parts: str) -> Column:
    """What a verdict depends on: the goal's question as bound, the document and whatever else the caller names."""
    return F.sha2(F.to_json(F.struct(*[F.col(p) for p in parts])), 256)


def remembered(asked: DataFrame, parts: list[str], memo: Versioned, provider: Completion, report: Callable[[int], None] | None = None) -> DataFrame:
    """asked: prompt and the columns ``parts`` that the verdict depends on. Adds response. Verdicts of a memo that several
    searches share are taken from it; only new keys are asked, once each, and stored before they are returned. ``report`` is
    called with how many were asked."""
    keyed = asked.withColumn("_key", verdict_key(*parts))
    new = keyed.select(F.col("_key").alias("key"), "prompt").join(memo.read().select("key"), "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
    answers = keep(complete(new, provider).select("key", "response"))
    n = answers.count()
    if n:
        memo.upsert(answers, ["key"])
    if report:
        report(n)
    return keyed.join(memo.read().withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


SLOT = r"\{\{\s*([A-Za-z][\w-]*)\s*\}\}"


def render_slots(templates: DataFrame) -> DataFrame:
    """templates: plan_id, id, template, slots (map of slot to node id). (plan_id, id, question, depends_on, reason): each
    ``{{slot}}`` becomes ${node.answer}, and what a question depends on are the nodes of its slots. A template with a slot
    that has no node, or a slot of the node itself, has a reason instead of a question."""
    names = F.array_distinct(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1)))
    rows = templates.withColumn("_slots", names).withColumn("_nodes", F.transform("_slots", lambda x: F.try_element_at("slots", x)))
    reason = F.when(F.exists("_nodes", lambda x: x.isNull()), "unknown_slot").when(F.array_contains("_nodes", F.col("id")), "own_slot")
    filled = F.aggregate("_slots", F.col("template"), lambda text, x: F.regexp_replace(text, F.concat(F.lit(r"\{\{\s*"), x, F.lit(r"\s*\}\}")), F.concat(F.lit(r"\$\{"), F.try_element_at("slots", x), F.lit(r".answer\}"))))
    return rows.select("plan_id", "id", F.when(reason.isNull(), filled).alias("question"), F.when(reason.isNull(), F.array_sort(F.array_distinct("_nodes"))).alias("depends_on"), reason.alias("reason"))


def recover_in_rounds(questions: DataFrame, nodes: DataFrame, replan: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], memo: Versioned, provider: Completion, most: int = 4, report: Callable[[int], None] | None = None) -> DataFrame:
    """recover, whose search binds a new plan's nodes level by level with the memo that the first search filled.

    verify turns nodes whose dependencies are bound (plan_id, id, question with answers filled in) into rows to ask
    (plan_id, id, question, passage, prompt); a response is the answer, empty for none. Of a node's answers the one of the
    least passage counts. Nodes whose dependencies stay unbound stay unbound too."""

    def search(new: DataFrame) -> DataFrame:
        state = keep(new.select("plan_id", "id", "question", "depends_on", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("passage")))
        for _ in range(most):
            bound = state.where("answer IS NOT NULL").groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "answer"))).alias("bound"))  # few nodes a plan
            open_ = state.where("answer IS NULL").join(bound, "plan_id", "left").withColumn("bound", F.coalesce("bound", F.create_map().cast("map<string,string>")))
            ready = open_.where(F.forall("depends_on", lambda d: F.try_element_at("bound", d).isNotNull()))
            filled = F.aggregate("depends_on", F.col("question"), lambda q, d: F.replace(q, F.concat(F.lit("${"), d, F.lit(".answer}")), F.try_element_at("bound", d)))
            asked = verify(keep(ready.select("plan_id", "id", filled.alias("question"))))
            found = keep(remembered(asked, ["question", "passage"], memo, provider, report).where("response <> ''"))
            best = found.groupBy("plan_id", "id").agg(F.min(F.struct("passage", "response")).alias("b"))
            if best.isEmpty():
                break
            state = keep(state.join(best, ["plan_id", "id"], "left").select("plan_id", "id", "question", "depends_on", F.coalesce("answer", "b.response").alias("answer"), F.coalesce("passage", "b.passage").alias("passage")))
        return state

    return recover(questions, nodes, replan, search, keep)


_KINDS = "plan_id long, kind string"


def _kind(group: pd.DataFrame) -> pd.DataFrame:
    nodes = [{"id": i, "depends_on": list(d)} for i, d in zip(group["id"], group["depends_on"])]
    return pd.DataFrame({"plan_id": [int(group["plan_id"].iloc[0])], "kind": [relations.recovery_kind(nodes, set(group.loc[group["bound"], "id"]))]})


def failures(nodes: DataFrame) -> DataFrame:
    """nodes: plan_id, id, depends_on, bound (whether an answer is known). What each plan needs: complete, restart,
    bridge_missing or terminal_missing."""
    return nodes.groupBy("plan_id").applyInPandas(_kind, _KINDS)


@F.pandas_udf(T.StringType())
def _kept_to(queries: pd.Series, nodes: pd.Series) -> pd.Series:
    return pd.Series([relations.repair_reason(q or "", json.loads(n)) for q, n in zip(queries, nodes)])


def recover(questions: DataFrame, nodes: DataFrame, replan: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], keep: Keep) -> DataFrame:
    """questions: plan_id, question; nodes: plan_id, id, question, depends_on, answer, passage (null where unbound).

    Plans with a failure are planned anew by ``replan`` (plan_id, question, kind -> nodes without answers). A new plan counts
    only if it keeps to its question and differs from the old one; ``search`` then binds its nodes, and the plan is adopted
    only if every node is bound and cited. The others keep their old nodes."""
    kinds = keep(failures(nodes.withColumn("bound", F.col("answer").isNotNull())))
    failed = questions.join(kinds.where("kind <> 'complete'"), "plan_id")
    new = keep(replan(failed))
    told = new.groupBy("plan_id").agg(F.to_json(F.collect_list(F.struct("id", "question", "depends_on"))).alias("nodes"))  # few nodes a plan
    faithful = told.join(questions, "plan_id").where(_kept_to("question", "nodes").isNull()).select("plan_id")
    same = plan_signature(new).join(plan_signature(nodes), ["plan_id", "signature"], "left_semi").select("plan_id")
    tried = keep(search(new.join(faithful, "plan_id", "left_semi").join(same, "plan_id", "left_anti")))
    whole = tried.groupBy("plan_id").agg(F.bool_and(F.col("answer").isNotNull() & F.col("passage").isNotNull()).alias("ok")).where("ok").select("plan_id")
    adopted = keep(tried.join(whole, "plan_id", "left_semi").select(nodes.columns))
    return nodes.join(adopted.select("plan_id").distinct(), "plan_id", "left_anti").unionByName(adopted)


def fresh_bridges(adopted: DataFrame, questions: DataFrame) -> DataFrame:
    """adopted: plan_id, bridge_answer; questions: plan_id, question. Only bridges whose answer the question does not say."""
    both = adopted.join(questions, "plan_id")
    return both.where(~contains_phrase(evidence_norm(F.col("bridge_answer")), evidence_norm(F.col("question")))).select(adopted.columns)


PROPOSAL = "struct<removed: int, added: int, quote: string, confidence: double>"


def propose_swaps(ranked: DataFrame, questions: DataFrame, provider: Completion, slots: int = 5, pool: int = 10) -> DataFrame:
    """ranked: query_id, passage, rank, text. A model sees the first passages by rank and may name one swap by ranks;
    (query_id, removed, added, quote, confidence) of responses whose ranks exist."""
    first = ranked.where(F.col("rank") <= pool)
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage", "text"))).alias("all"))  # at most ``pool`` a query
    shown = F.array_join(F.transform("all", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n")
    asked = _ask(listed.join(questions, "query_id").select("query_id", "all", F.concat(F.lit("Question: "), "question", F.lit("\n"), shown).alias("prompt")), provider, PROPOSAL)
    at = lambda c: F.element_at(F.filter("all", lambda x: x["rank"] == F.col(f"parsed.{c}")), 1)["passage"]
    both = asked.where(F.exists("all", lambda x: x["rank"] == F.col("parsed.removed")) & F.exists("all", lambda x: x["rank"] == F.col("parsed.added")))
    return both.select("query_id", at("removed").alias("removed"), at("added").alias("added"), "parsed.quote", "parsed.confidence")


def run_mode(mode: str, state: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], keep: Keep) -> DataFrame:
    """The stages of an ablation mode in order, each written before the next."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    for name in MODES[mode]:
        state = keep(stages[name](state))
    return state
