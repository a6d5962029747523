"""Sources: the driver's tables, passages, question records, stores; and the graph source over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from hopweave.functions.text import hash_id

_PARAGRAPH = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "paragraph_text", "text")] + [T.StructField("is_supporting", T.BooleanType())])
QUESTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("_id", "id", "question", "answer", "reference", "obj", "possible_answers", "o_wiki_title", "o_aliases", "type")]
    + [
        T.StructField("answer_aliases", T.ArrayType(T.StringType())),
        T.StructField("question_decomposition", T.ArrayType(T.StructType([T.StructField("question", T.StringType())]))),
        T.StructField("paragraphs", T.ArrayType(_PARAGRAPH)),
        T.StructField("contexts", T.ArrayType(_PARAGRAPH)),
        T.StructField("supporting_facts", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("sent_id", T.IntegerType())]))),
        T.StructField("context", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))]))),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of question records of any of the four shapes; fields that a shape lacks are null."""
    return spark.read.option("multiLine", True).schema(QUESTION_SCHEMA).json(path)


def keyed_questions(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one object of records by key: the records, with ``key``. A question set is small; a file is one row."""
    kind = T.MapType(T.StringType(), QUESTION_SCHEMA)
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("key", "r")).select("key", "r.*")


def passage_text(title: str, *bodies: str):
    """Title, newline, first non-empty body."""
    return F.concat_ws("\n", F.coalesce(F.col(title), F.lit("")), F.coalesce(*[F.nullif(F.col(b), F.lit("")) for b in bodies], F.lit("")))


def sample_passages(samples: DataFrame, joint: str = " ") -> DataFrame:
    """Flat corpus of nested contexts, the first of equal passages kept in order. ``samples`` has sample_idx."""
    nested = samples.select("sample_idx", F.posexplode("context").alias("pos", "c"))
    flat = nested.select("sample_idx", "pos", F.concat_ws("\n", F.coalesce("c.title", F.lit("")), F.array_join("c.sentences", joint)).alias("passage"))
    return keep_first(flat, ["passage"], ["sample_idx", "pos"]).select("passage", "sample_idx", "pos")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def complete_gold(corpus: DataFrame, gold: DataFrame) -> DataFrame:
    """The corpus with gold passages that it lacks."""
    return corpus.unionByName(gold.select("passage").distinct().join(corpus, "passage", "left_anti"))


def vector_store(spark: SparkSession, root: str, namespace: str) -> DataFrame:
    return spark.read.parquet(f"{root}/vdb_{namespace}")


def append_vectors(df: DataFrame, root: str, namespace: str) -> None:
    """Adds rows; nothing stored before is rewritten."""
    df.select("hash_id", "content", "embedding").write.mode("append").parquet(f"{root}/vdb_{namespace}")


def http_status_counts(lines: DataFrame) -> DataFrame:
    codes = F.regexp_extract_all("value", F.lit(r'POST /v1/chat/completions HTTP/1\.1" (\d{3})'), F.lit(1))
    return lines.select(F.explode(codes).alias("code")).groupBy("code").count()


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of each passage (an order): who placed it, what it holds, who supplies that, where the customer lives."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    label = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    triple = lambda order, s, p, o: (label("order", order).alias("chunk"), s.alias("subj"), F.lit(p).alias("pred"), o.alias("obj"))
    placed = orders.select(*triple("o_orderkey", label("order", "o_orderkey"), "placed by", label("customer", "o_custkey")))
    holds = lines.select(*triple("l_orderkey", label("order", "l_orderkey"), "contains", label("part", "l_partkey")))
    supplied = lines.select(*triple("l_orderkey", label("part", "l_partkey"), "supplied by", label("supplier", "l_suppkey")))
    homes = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    lives = orders.join(homes, orders.o_custkey == homes.c_custkey).select(*triple("o_orderkey", label("customer", "o_custkey"), "lives in", F.lower("n_name")))
    return placed.unionByName(holds).unionByName(supplied).unionByName(lives)


def with_ids(triples: DataFrame) -> DataFrame:
    return triples.withColumns({"chunk_id": hash_id("chunk", F.col("chunk")), "subj_id": hash_id("entity", F.col("subj")), "obj_id": hash_id("entity", F.col("obj"))})
