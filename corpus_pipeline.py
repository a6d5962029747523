"""Five stages over documents; each reads all that the one before kept, as a table written in between.

Nulls in any column, empty and very long texts, repeated rows, further columns of any name and empty tables pass through;
each stage says what it makes of them. Packing takes a null text as an empty one and gives each row pieces of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.llm import decontaminate, minhash_dedup, packing, quality_classifier, secrets_scan
from hopweave.llm.columns import as_row, from_row
from hopweave.llm.queries import table, tokenizer_file
from hopweave.llm.scratch import Scratch

SIMILAR_PERCENT = 80  # the near-duplicate stage links from here on; op1's own contract has 85


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows as a struct, with a key of each, written once so that the key is the same in every reading. Verdicts go by it,
    not by doc_id, which may be null or repeated."""
    return scratch.keep(as_row(docs, F.monotonically_increasing_id().alias("_row")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows travel whole through the scoring: each is judged by its own text, whatever its doc_id, a null text as an empty
    one. Without labels of both classes nothing can be told apart and all rows stay."""
    rows = as_row(docs, F.col("doc_id"), F.col("text"))
    scored = quality_classifier.classify(rows, table(spark, sf_dir, "labels"), Scratch(spark, "pipeline-quality"), carry=("row",))
    return from_row(scored.where("predicted = 1"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked from a similarity of 0.8 on, that of the least doc_id. Rows without a doc_id
    stay, as in op1; rows without words make a group only with rows of the same doc_id and text."""
    scratch = Scratch(spark, "pipeline-near")
    keyed = _keyed(docs, scratch)
    named = keyed.where("row.doc_id IS NOT NULL")
    verdicts = minhash_dedup.near_duplicates(named.select(F.col("_row").alias("doc_id"), "row.text"), scratch, percent=SIMILAR_PERCENT)
    own = named.select("_row", "row.doc_id", F.md5(F.coalesce("row.text", F.lit(""))).alias("content"))
    rows = own.join(verdicts.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "_row")
    linked = F.col("n_shingles") > 0
    groups = rows.groupBy(linked.alias("linked"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("g"), F.when(~linked, F.col("content")).alias("content"))
    first = groups.agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first._row")
    return from_row(keyed.join(first, "_row", "left_semi").unionByName(keyed.where("row.doc_id IS NULL")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no phrase of the benchmark occurs; a null or empty text has none, and without a benchmark all stay."""
    scratch = Scratch(spark, "pipeline-benchmark")
    keyed = _keyed(docs, scratch)
    found = decontaminate.find_spans(keyed.select(F.col("_row").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"), scratch)
    return from_row(keyed.join(found.where("size(spans) = 0").select(F.col("doc_id").alias("_row")), "_row", "left_semi"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; spans give way to a mark, and n_chars follows the text. A null text stays null, with its n_chars."""
    clean = secrets_scan.redact(secrets_scan.find(as_row(docs, F.col("text"))))
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("row")["n_chars"])
    return from_row(clean, docs.columns, text=F.col("text"), n_chars=length)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, Scratch(spark, "pipeline-pack"), tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
