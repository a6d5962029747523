"""Tables that an index leaves behind: extractions, graphs, vectors, caches, checkpoints, manifests, reports."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from hopweave.operators.experiments import digest
from hopweave.operators.providers import Completion, Embedding, complete, embed, needs_retry

#: Text-normalisation schemas that an index may be pinned to.
SCHEMAS = ("ascii-1", "unicode-1")


def read_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


STALE_SECONDS = 600


class Conflict(Exception):
    """Another writer committed first."""


class Commits:
    """Several tables under one log of commits: a commit names the folder of every table, so readers see all of them change
    together or not at all. Who creates the claim to commit n + 1 may make it; a second writer that started from commit n is
    refused. HDFS creates a file without overwriting in one step; a local disk looks first, a moment before. A claim whose
    writer was lost is void after STALE_SECONDS."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last commit, 0 before the first one."""
        folder = self._path(f"{self.root}/_commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """Name, folder and schema of each table as of a commit, the last one by default."""
        n = self.version() if version is None else version
        if n == 0:
            return {}
        lines = self.spark.read.text(f"{self.root}/_commits/{n}").collect()  # one line a table
        return {entry["name"]: entry for entry in (json.loads(r.value) for r in lines)}

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        entry = self.tables(version).get(name)
        return entry and self.spark.read.schema(entry["schema"]).parquet(f"{self.root}/{entry['folder']}")

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes tables and commits them on top of ``base`` (the last commit by default); others stay as they were."""
        start = self.version() if base is None else base
        claim, target = self._path(f"{self.root}/_claims/{start + 1}"), self._path(f"{self.root}/_commits/{start + 1}")
        if self._fs.exists(claim) and (self._fs.exists(target) or time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 <= STALE_SECONDS):
            raise Conflict(f"commit {start + 1} of {self.root} is taken")
        entries = self.tables(start)
        for name, df in sorted(tables.items()):
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            entries[name] = {"name": name, "folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
        text = "\n".join(json.dumps(entries[n]) for n in sorted(entries))
        if self._fs.exists(claim) and not self._fs.exists(target) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
            self._fs.delete(claim, False)
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as error:
            if not self._fs.exists(claim):
                raise error
            raise Conflict(f"commit {start + 1} of {self.root} is taken") from None
        # Written whole beside the log, then put in its place: a reader never meets half a commit.
        spare = self._path(f"{self.root}/_spare-{uuid.uuid4().hex}")
        out = self._fs.create(spare, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(spare, target):
            raise Conflict(f"commit {start + 1} of {self.root} could not be put in its place")
        return start + 1


def _again(attempt, tries: int = 60):
    """attempt(), made again a little later when another writer was first."""
    for left in range(tries, 0, -1):
        try:
            return attempt()
        except Conflict:
            if left == 1:
                raise
            time.sleep(0.5)


class Versioned:
    """A table in numbered snapshots: readers see the last one that was committed whole, so a lost writer changes nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.log = Commits(spark, self.root)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.log.read("rows", version)
        return found if found is not None else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> DataFrame:
        """Whoever comes last wins."""
        return self.read(_again(lambda: self.log.commit({"rows": rows})))

    def upsert(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows take the place of stored ones of their keys; of several new ones of a key, the least in the order of their
        other columns. Should another writer commit meanwhile, its rows are read and the merge is made again."""

        def attempt() -> int:
            base = self.log.version()
            old = self.read(base)
            others = [c for c in old.columns if c not in keys]
            new = rows.select(old.columns).groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*keys, "_row.*") if others else rows.select(keys).distinct()
            return self.log.commit({"rows": old.join(new.select(keys), keys, "left_anti").unionByName(new.select(old.columns))}, base)

        return self.read(_again(attempt))


EXTRACTIONS = "idx string, passage string, entities array<string>, triples array<array<string>>, status string, contract string"


def pending(chunks: DataFrame, stored: DataFrame, contract: str) -> DataFrame:
    """Chunks still to process: without a stored row, or with one that failed or is of another contract."""
    good = stored.where(~needs_retry() & (F.col("contract") == contract))
    return chunks.join(good.select("idx"), "idx", "left_anti")


def extraction_stats(rows: DataFrame) -> DataFrame:
    """One row: documents, and the mean characters and words of their entities."""
    each = rows.select(F.explode("entities").alias("e"))
    sizes = each.agg(F.round(F.avg(F.length("e")), 4).alias("avg_ent_chars"), F.round(F.avg(F.size(F.split(F.trim("e"), r"\s+"))), 4).alias("avg_ent_words"))
    return rows.agg(F.count(F.lit(1)).alias("docs")).join(F.broadcast(sizes))  # one row each


def overlay(base: DataFrame, checkpoint: DataFrame, contract: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base rows with those of a checkpoint on top, and the checkpoint's rejected rows with a reason: of another contract,
    of no chunk, with another passage than the chunk's, or failed where the base has a good row."""
    known = chunks.select("idx", F.col("passage").alias("now"))
    good_base = base.where(~needs_retry()).select("idx", F.lit(True).alias("base_good"))
    judged = checkpoint.join(known, "idx", "left").join(good_base, "idx", "left").withColumn(
        "reason",
        F.when(F.col("contract") != contract, "other_contract").when(F.col("now").isNull(), "unknown_chunk").when(F.col("now") != F.col("passage"), "changed_passage")
        .when(needs_retry() & F.coalesce("base_good", F.lit(False)), "worse_than_base"),
    )
    taken = judged.where("reason IS NULL").select(base.columns)
    return base.join(taken.select("idx"), "idx", "left_anti").unionByName(taken), judged.where("reason IS NOT NULL").select("idx", "reason")


def open_checkpoint(spark: SparkSession, root: str, identity: dict[str, str]) -> Versioned:
    """A checkpoint pinned to an identity (model, prompt, schema ...); another identity than the stored one is refused."""
    rows = sorted(identity.items())
    stored = read_or(spark, f"{root}/identity", "key string, value string")
    found = sorted((r.key, r.value) for r in stored.collect())
    if found and found != rows:
        raise ValueError(f"the checkpoint belongs to {dict(found)}")
    if not found:
        spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{root}/identity")
    return Versioned(spark, f"{root}/rows", EXTRACTIONS)


def save_graph(root: str, vertices: DataFrame, edges: DataFrame, directed: bool, base: int | None = None) -> int:
    """Vertices and edges in one commit, whose number it returns; see Commits for base."""
    log = Commits(edges.sparkSession, root)
    stored = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(directed).alias("directed"))
    return log.commit({"vertices": vertices.select("name", "kind"), "edges": stored}, base)


def load_graph(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of one commit, the last one by default; empty ones where nothing was saved."""
    log = Commits(spark, root)
    n = log.version() if version is None else version
    vertices, edges = log.read("vertices", n), log.read("edges", n)
    return vertices if vertices is not None else spark.createDataFrame([], "name string, kind string"), edges if edges is not None else spark.createDataFrame([], "src string, dst string, weight double, directed boolean")


def guard_stale(edges: DataFrame, extractions: DataFrame) -> None:
    """Refuses a graph with edges of chunks whose extraction is missing or failed."""
    bad = edges.select(F.col("src").alias("idx")).join(extractions.where(needs_retry()).select("idx"), "idx", "left_semi")
    if not bad.isEmpty():
        raise ValueError("the graph has edges of chunks that are still to be extracted; rebuild it")


def cache_key(**parts: Column) -> Column:
    """One key of named parts, the same for equal parts in any order."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(parts.items())])), 256)


def cached_responses(df: DataFrame, store: Versioned, provider: Completion, model: Column, legacy: Column | None = None) -> DataFrame:
    """df: prompt. Adds response and hit. Stored under the key of model and prompt; where given, an older key form is looked
    up too. What the provider answers is stored before it is returned."""
    keyed = df.withColumns({"key": cache_key(model=model, prompt=F.col("prompt")), "_old": legacy if legacy is not None else F.lit(None).cast("string")})
    known = store.read()
    old = known.select(F.col("key").alias("_old"), F.col("response").alias("_r"))
    misses = keyed.join(known, "key", "left_anti").join(old, "_old", "left_anti").select("key", "prompt").dropDuplicates(["key"])
    hits = known.withColumn("hit", F.lit(True))
    store.upsert(complete(misses, provider).select("key", "response"), ["key"])
    after = store.read().join(hits.select("key", "hit"), "key", "left")
    return keyed.join(after, "key", "left").join(old, "_old", "left").select(*df.columns, F.coalesce("response", "_r").alias("response"), (F.coalesce("hit", F.lit(False)) | F.col("_r").isNotNull()).alias("hit"))


def cached_embeddings(df: DataFrame, store: Versioned, provider: Embedding, instruction: str, max_length: int) -> DataFrame:
    """df: text. Adds embedding; vectors are stored by instruction, text and length bound, and each text is embedded once."""
    keyed = df.withColumn("key", cache_key(instruction=F.lit(instruction), prompt=F.col("text"), max_length=F.lit(max_length)))
    fresh = keyed.select("key", "text").dropDuplicates(["key"]).join(store.read(), "key", "left_anti")
    store.upsert(embed(fresh, provider).select("key", F.col("embedding").cast("array<float>").alias("embedding")), ["key"])
    return keyed.join(store.read(), "key").drop("key")


def write_manifest(spark: SparkSession, root: str, normaliser: str, contract: str, tables: dict[str, DataFrame]) -> None:
    """One row for each table of an index: its rows' digest, and the normaliser and contract all are pinned to."""
    if normaliser not in SCHEMAS:
        raise ValueError(f"unknown normalisation schema {normaliser}")
    rows = [(name, digest(df), normaliser, contract) for name, df in sorted(tables.items())]
    spark.createDataFrame(rows, "name string, digest string, normaliser string, contract string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest")


def check_manifest(spark: SparkSession, root: str, contract: str, tables: dict[str, DataFrame]) -> str:
    """The normaliser an index is pinned to; an error if the contract or any table is another one."""
    rows = {r.name: r for r in spark.read.parquet(f"{root}/manifest").collect()}
    kinds = {(r.normaliser, r.contract) for r in rows.values()}
    if len(kinds) != 1 or next(iter(kinds))[0] not in SCHEMAS:
        raise ValueError("unknown normalisation schema")
    if next(iter(kinds))[1] != contract:
        raise ValueError("the index has another extraction contract")
    changed = [n for n, df in tables.items() if n not in rows or digest(df) != rows[n].digest]
    if changed:
        raise ValueError(f"changed since the index was built: {', '.join(sorted(changed))}")
    return next(iter(kinds))[0]


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


ABLATIONS = "question string, sample_id string, query_index long, pool array<struct<doc_hash: string, score: double>>, evidence_call_budget int"


def ablation_inputs(spark: SparkSession, path: str, passages: DataFrame) -> DataFrame:
    """One row for each pool entry: query_index, position, passage, score, evidence_call_budget. A record that breaks the
    schema or names an unknown passage is an error."""
    records = spark.read.schema(ABLATIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    pool = records.select("query_index", "evidence_call_budget", F.posexplode("pool").alias("position", "p")).select("query_index", "evidence_call_budget", "position", "p.doc_hash", "p.score")
    named = pool.join(passages.select(F.md5("passage").alias("doc_hash"), "passage"), "doc_hash", "left")
    known = F.when(F.col("passage").isNull(), F.raise_error(F.concat(F.lit("unknown passage "), "doc_hash")).cast("string")).otherwise(F.col("passage"))
    return named.select("query_index", "position", known.alias("passage"), "score", "evidence_call_budget")
