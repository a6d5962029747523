"""What a question record says about its hops, gold passages and gold answers, for each of the four shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIXED_HOPS = {"hotpotqa": 2, "2wikimultihopqa": 2, "nq": 1, "popqa": 1}


def hop_label(dataset: str) -> Column:
    """Benchmark hops: the length of a decomposition (2 to 4, at least 2), or the dataset's prior."""
    n = F.size("question_decomposition")
    if dataset == "musique":
        return F.when(n.between(2, 4), n).otherwise(F.raise_error(F.concat(F.lit("decomposition of length "), n)).cast("int"))
    if dataset == "fanoutqa":
        return F.greatest(F.lit(2), n)
    if dataset in FIXED_HOPS:
        return F.lit(FIXED_HOPS[dataset])
    raise ValueError(f"unknown dataset {dataset}")


def infer_hops() -> Column:
    """Hops of an unlabelled record: decomposition, else the number in its id, else its supporting facts."""
    from_id = F.regexp_extract(F.coalesce("id", "_id", F.lit("")), r"^([234])hop", 1)
    return F.coalesce(F.nullif(F.size(F.coalesce("question_decomposition", F.array())), F.lit(0)), F.nullif(from_id, F.lit("")).cast("int"), F.nullif(F.size(F.coalesce("supporting_facts", F.array())), F.lit(0)))


def gold_passages(records: DataFrame, joint: str = " ") -> DataFrame:
    """(question, passage) of supporting passages, each once; a paragraph without a mark counts as supporting."""
    text = lambda p: F.concat_ws("\n", F.coalesce(p["title"], F.lit("")), F.coalesce(F.nullif(p["text"], F.lit("")), F.nullif(p["paragraph_text"], F.lit("")), F.lit("")))
    marked = lambda c: F.transform(F.filter(F.coalesce(F.col(c), F.array()), lambda p: F.coalesce(p["is_supporting"], F.lit(True))), text)
    titles = F.transform(F.coalesce("supporting_facts", F.array()), lambda f: f["title"])
    facts = F.transform(F.filter(F.coalesce("context", F.array()), lambda c: F.array_contains(titles, c["title"])), lambda c: F.concat_ws("\n", c["title"], F.array_join(c["sentences"], joint)))
    return records.select("question", F.explode(F.array_distinct(F.concat(marked("paragraphs"), marked("contexts"), facts))).alias("passage"))


def gold_answers(records: DataFrame) -> DataFrame:
    """question and the distinct answers: the answer, its aliases, and aliases stored as JSON lists."""
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.when(F.col(c).isNotNull(), F.array(c)), F.array())
    single = F.array_compact(F.array(F.coalesce("answer", "reference", "obj"), F.col("o_wiki_title")))
    every = F.concat(single, F.coalesce("answer_aliases", F.array()), listed("possible_answers"), listed("o_aliases"))
    return records.select("question", F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))).alias("answers"))


def write_hop_labels(records: DataFrame, answers: DataFrame, path: str) -> DataFrame:
    """records: the question records; answers: question, predicted. Writes question, hops and predicted as JSON lines, for
    questions that both have, and returns them."""
    labelled = records.select("question", infer_hops().alias("hops")).join(answers.select("question", "predicted"), "question")
    labelled.write.mode("errorifexists").json(path)
    return records.sparkSession.read.schema(labelled.schema).json(path)
