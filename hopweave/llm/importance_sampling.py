"""Importance resampling towards a target text collection, over hashed runs of words.

Words are runs of letters, digits and non-ASCII characters, A to Z in lower case; features are all runs of 1 to
``longest`` words. A slice of texts maps its distinct words to integers and holds a run of n words as the integer of its
first n - 1 words with that of the last; each distinct run's bytes are hashed once in the slice, and the buckets are
joined back to all places by the inverse index. Slices are bounded by bytes, so a task's memory is too, and only bucket
counts (one row a bucket and task) are exchanged.

A bucket's gain is 1000 times the log ratio of its smoothed shares in target and corpus, floored; a document's weight the
floored mean of gains over its features, its score the weight plus Gumbel noise from a hash of its id. The best scores
are drawn without replacement: ranks come from a range exchange, not from one sorted partition.

A null or empty text has no features and weight 0. Rows of a repeated doc_id are rows of their own, with the same noise;
ties of score go to the smaller doc_id, then to the earlier row. A row without doc_id has no score, is not drawn and does
not count among those drawn from. Other columns are not read. An empty table gives an empty one; an empty target gives
gains from its smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopweave.llm.hashing import byte_list
from hopweave.llm.scratch import Scratch

SLICE_BYTES = 8 << 20
LOWER = bytes(ord(" ") if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))


class _Dictionary(dict):
    """Integers of words, in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slice_buckets(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words in each text, and for each n the buckets of all its runs of n words, text after text."""
    ids = _Dictionary()
    own = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in (t.translate(LOWER).split() for t in texts)]
    n_words = np.array([len(x) for x in own], np.int64)
    words, place = list(ids), np.concatenate(own) if own else np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(place))  # words from here to the end of the text
    spaced = [b" " + w for w in words]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    out, run = [(crc % buckets)[place]], place
    for n in range(2, longest + 1):
        starts = left[: len(run)] >= n
        pairs, run_of = np.unique((run * len(words))[starts] + place[np.flatnonzero(starts) + n - 1], return_inverse=True)
        first, last = np.divmod(pairs, max(len(words), 1))
        crc = np.fromiter(map(zlib.crc32, map(spaced.__getitem__, last.tolist()), crc[first].tolist()), np.uint32, len(pairs))
        out.append((crc % buckets)[run_of])
        run = np.zeros(len(starts), np.int64)
        run[starts] = run_of
    return n_words, out


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    yield begin, len(texts)


def _hashed(longest: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column("text"))
            for begin, end in _slices(texts):
                n_words, by_n = slice_buckets(texts[begin:end], longest, buckets)
                counts = [np.maximum(n_words - n, 0) for n in range(longest)]
                cuts = [np.concatenate(([0], np.cumsum(c))) for c in counts]
                kept = [b"".join(b[c[i] : c[i + 1]].astype(kind).tobytes() for b, c in zip(by_n, cuts)) for i in range(end - begin)]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n_words), pa.array(kept, pa.binary())], names=["doc_id", "row", "n_words", "buckets"])

    return run, kind


def _of(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // np.dtype(kind).itemsize for r in rows], np.int64)


def _counted(kind, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_of(batch.column(0), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def _weighed(kind, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _of(batch.column("buckets"), kind)
            sums = np.concatenate(([0], np.cumsum(gains[values])))[np.concatenate(([0], np.cumsum(n)))]
            weight = np.diff(sums) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "n_words")), pa.array(n), pa.array(weight)], names=["doc_id", "row", "n_words", "n_features", "weight"])

    return run


def features(rows: DataFrame, longest: int, buckets: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, row, n_words, buckets) of rows (doc_id, text), written once, and the count of each bucket over all rows."""
    run, kind = _hashed(longest, buckets)
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, row long, n_words long, buckets binary"
    kept = scratch.keep(keyed.mapInArrow(run, schema))
    counted = kept.select("buckets").mapInArrow(_counted(kind, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in counted.collect():  # a row a bucket at most
        total[r["bucket"]] = r["n"]
    return kept, total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, more = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000.0 * math.log((b + 1.0) * (s + more) / ((a + 1.0) * (t + more)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs (doc_id, text); target has a column text.
    Of the rows with ``least_words`` or more, ``percent`` in a hundred are drawn and have a rank."""
    kept, corpus = features(docs.select("doc_id", "text"), longest, buckets, scratch)
    wanted, aim = features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets, scratch)
    scratch.drop(wanted)
    kind = _hashed(longest, buckets)[1]
    id_type = dict(docs.dtypes)["doc_id"]
    weighed = kept.mapInArrow(_weighed(kind, gains(corpus, aim)), f"doc_id {id_type}, row long, n_words long, n_features long, weight long")
    part = f"cast(conv(substring(sha2(concat('{seed}:', doc_id), 256), 1, 8), 16, 10) AS double)"
    noise = F.expr(f"bigint(floor(-1000D * ln(-ln(({part} + 0.5D) / 4294967296D))))")
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise))
    scratch.drop(kept)
    asked = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    order = [F.desc("score"), F.col("doc_id"), F.col("row")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Places inside a range are in the low 33 bits of these numbers, the range in the bits above.
    placed = scratch.keep(scored.where(asked).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    counts = dict(placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    offsets = docs.sparkSession.createDataFrame(sorted(before.items()), "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part").select(*names, F.when(rank <= percent * total // 100, rank).alias("rank"))
    return drawn.unionByName(scored.where(~asked).select(*names, F.lit(None).cast("long").alias("rank")))
