"""Model providers behind protocols, their caches as tables, and the resumable extraction queue.

A provider is any picklable callable over a batch of strings. The deterministic ones here stand for models in tests and
offline runs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hopweave.functions.text import hash_id

Completion = Callable[[list[str]], list[str]]
Embedding = Callable[[list[str]], np.ndarray]


def hash_embedding(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors from hashed tokens: texts that share words are near each other."""
    out = np.zeros((len(texts), dimension))
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            out[row, h % dimension] += 1.0 if h >> 63 else -1.0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 0, out / np.maximum(length, 1e-12), 1 / np.sqrt(dimension))


def rule_extractor(texts: list[str]) -> list[str]:
    """Triples (first word, verb, last word) of sentences with a known verb, as JSON."""
    verbs = ("is", "was", "wrote", "has", "of", "de", "la")
    out = []
    for text in texts:
        triples = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
            words = re.findall(r"\w+", sentence)
            verb = next((w for w in words[1:-1] if w.lower() in verbs), None)
            if verb:
                triples.append([words[0], verb, words[-1]])
        out.append(json.dumps({"triples": triples}))
    return out


def embed(df: DataFrame, provider: Embedding, text: str = "text") -> DataFrame:
    """Adds ``embedding`` in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = provider(b.column(b.schema.get_field_index(text)).to_pylist())
            yield b.append_column("embedding", pa.array(list(vectors), pa.list_(pa.float64())))

    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{columns}, embedding array<double>")


def complete(df: DataFrame, provider: Completion, prompt: str = "prompt") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("response", pa.array(provider(b.column(b.schema.get_field_index(prompt)).to_pylist()), pa.string()))

    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{columns}, response string")


def render(template: str, **columns) -> Column:
    """Fills $name parts of a template with columns."""
    parts = [F.lit(p) if i % 2 == 0 else columns[p] for i, p in enumerate(re.split(r"\$(\w+)", template))]
    return F.concat(*parts)


def cached(df: DataFrame, cache: DataFrame, provider: Completion, version: str, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Answers with a ``hit`` flag, and the new rows for the cache (key, response). Only misses reach the provider, each
    distinct prompt once."""
    keyed = df.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), F.col(prompt).alias("prompt"))), 256))
    missing = keyed.select("key", F.col(prompt).alias("prompt")).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = complete(missing, provider).select("key", "response")
    hits = keyed.join(cache.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False))), "key")
    return hits, fresh


def extract(passages: DataFrame, provider: Completion) -> DataFrame:
    """Extraction rows: idx, passage, triples, status (success, empty_valid or failed)."""
    schema = "struct<triples: array<array<string>>>"
    done = complete(passages.select(hash_id("chunk", F.col("passage")).alias("idx"), "passage"), provider, "passage")
    triples = F.from_json("response", schema)["triples"]
    status = F.when(triples.isNull(), "failed").when(F.size(triples) == 0, "empty_valid").otherwise("success")
    return done.select("idx", "passage", F.coalesce(triples, F.array().cast("array<array<string>>")).alias("triples"), status.alias("status"))


def needs_retry(status: str = "status"):
    return F.col(status).isNull() | F.col(status).isin("failed", "partial")


def run_queue(passages: DataFrame, provider: Completion, keep: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Rounds over what is pending; each round's rows are written before the next begins, so a restart resumes.

    A row of a later round takes the place of an earlier one of its idx."""
    done, pending = None, passages
    for n in range(rounds):
        new = keep(extract(pending, provider).withColumn("round", F.lit(n)))
        done = new if done is None else keep(done.join(new.select("idx"), "idx", "left_anti").unionByName(new))
        failed = done.where(needs_retry()).select("passage")
        if failed.isEmpty():
            break
        pending = failed
    return done


def publish(rows: DataFrame, strict: bool) -> DataFrame:
    """Strict: refuses while a row failed. Lenient: failed rows keep their passage without triples."""
    if strict and not rows.where(needs_retry()).isEmpty():
        raise ValueError("extraction rows failed; publish leniently or run them again")
    return rows.withColumn("triples", F.when(needs_retry(), F.array().cast("array<array<string>>")).otherwise(F.col("triples")))
