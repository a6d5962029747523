"""Benchmark decontamination: an FM-index for each shard of training documents, searched for all benchmark windows.

Words are lower-cased (A-Z) runs of letters, digits and characters from U+0080. A window is ten consecutive words of a
benchmark item; a shorter item is one window. A shard's index holds the runs of words that the benchmark knows, since
no window crosses another word; runs shorter than every window are left out for the same reason. Occurrences merge into
removal spans per document.

The benchmark is the query set: it is read in blocks of bounded size, and each block meets all rows in a pass of its
own. Nulls have no words. Repeated rows are judged row by row; of an item_id that comes twice all windows count. Empty
tables give an empty result, or no hits.

An item without an item_id counts like others: its words are hit, and all such items together are one item, which the list of
ids leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopweave.llm.fm_index import FMIndex
from hopweave.llm.hashing import byte_list
from hopweave.llm.scratch import Scratch

WINDOW = 10
BLOCK_WORDS = 2_000_000  # of benchmark text searched in one pass
SHARD_BYTES = 48_000_000  # of documents in one index

_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_SPACE).split()


class Phrases:
    """The distinct windows of a block of items, as symbols from 2 up; 1 parts runs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in text]
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.patterns = [np.array(p, np.int64) for p in found]
        self.items = [sorted(x, key=lambda i: (i is None, i or "")) for x in found.values()]
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.least = int(self.lengths.min()) if len(self.lengths) else 0


def search(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Merged spans of words (end exclusive) and the items found, of each text."""
    nothing: tuple = ([], [])
    out = [nothing] * len(texts)
    get, parts, docs, offsets, at = phrases.symbol.get, [], [], [], 0
    for doc, text in enumerate(texts):
        ids = np.fromiter((get(w, 0) for w in text), np.int64, len(text))
        edge = np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8))
        for begin, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if end - begin >= phrases.least:
                parts += [ids[begin:end], np.ones(1, np.int64)]
                docs.append(doc)
                offsets.append((at, begin))
                at += end - begin + 1
    if not parts or not phrases.patterns:
        return out
    index = FMIndex(np.concatenate(parts), len(phrases.symbol) + 2)
    low, high = index.ranges(phrases.patterns)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    places = index.locate(rows)
    cover = np.zeros(at + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + phrases.lengths[which], -1)
    covered = np.cumsum(cover) > 0
    starts, begins = (np.array(x, np.int64) for x in zip(*offsets))
    run_doc = np.array(docs)
    edge = np.diff(np.concatenate(([0], covered, [0])).astype(np.int8))
    spans: dict[int, list[tuple[int, int]]] = {}
    for begin, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        run = np.searchsorted(starts, begin, side="right") - 1
        shift = begins[run] - starts[run]
        spans.setdefault(int(run_doc[run]), []).append((int(begin + shift), int(end + shift)))
    pairs = np.unique(run_doc[np.searchsorted(starts, places, side="right") - 1] * len(counts) + which)
    items: dict[int, set[str]] = {}
    for pair in pairs.tolist():
        items.setdefault(pair // len(counts), set()).update(phrases.items[pair % len(counts)])
    for doc, found in spans.items():
        out[doc] = (found, sorted(items[doc], key=lambda x: (x is None, x or "")))
    return out


_SPANS = "array<struct<start:long,end:long>>"


def _scan(items: list[tuple[str, list[bytes]]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, width)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = search([t for _, _, t in held], phrases)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [
                pa.array([d for d, _, _ in held], pa.int64()), pa.array([k for _, k, _ in held], pa.int64()), pa.array([len(t) for _, _, t in held], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in found], kind), pa.array([i for _, i in found], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "n_words", "spans", "items"])

        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2))):
                held.append((doc_id, key, words(text)))
                size += len(text)
                if size >= SHARD_BYTES // 8:  # words held as objects take about eight times their text
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _blocks(benchmark: DataFrame, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col(text)).toLocalIterator():
        own = words((row[1] or "").encode())
        if own:
            block.append((row[0], own))
            size += len(own)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def find_spans(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (merged, in words) and items (sorted as strings) of each row of docs."""
    source = docs.select("doc_id", F.lit(0).cast("long").alias("row_key"), F.col(text).alias("text"))
    schema = f"doc_id long, row_key long, n_words long, spans {_SPANS}, items array<string>"
    results, first = [], None
    for block in _blocks(benchmark, text):
        if first is None:
            first = block
            continue
        if not results:  # a second block: rows need a key of their own to meet again
            source = scratch.keep(docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), F.col(text).alias("text")))
            results.append(scratch.keep(source.mapInArrow(_scan(first, width), schema)))
            first = []
        results.append(scratch.keep(source.mapInArrow(_scan(block, width), schema)))  # now, so that the driver holds one block
    if not results:
        return source.mapInArrow(_scan(first or [], width), schema).drop("row_key")
    together = results[0]
    for more in results[1:]:
        together = together.unionByName(more)
    merged = together.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = F.expr(
        f"aggregate(all, cast(array() AS {_SPANS}), (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= x.start "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) ELSE concat(acc, array(x)) END)"
    )
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items")


def report(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
