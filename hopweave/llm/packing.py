"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most ``size`` tokens, cut only where longer. The plan sees nothing but how many pieces
each length has, so it holds at most ``size`` counts whatever the input. From the longest length down, gaps are
filled exactly by a single length, a pair or a triple whose sum fits under the availability counts; what is left goes
best-fit. Each step takes a combination as often as its rarest length allows, so a plan has at most a few times
``size`` combinations. Pieces meet the plan through their rank among pieces of equal length: local ranks from the
tokenizing task, and sums over tasks by window.

A null text is empty and still has its end token. Rows of equal doc_id are packed as documents of their own. An empty
table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hopweave.llm.scratch import Scratch
from hopweave.llm.tokens import encoder

SIZE = 2048


@dataclass(frozen=True)
class Fill:
    lengths: tuple[int, ...]  # the pieces of one sequence, in order of their offsets
    times: int


class Counts:
    """Availability of each length, with the sums of pairs as an index that is renewed when lengths run out."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.size = size

    def can(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= n for x, n in Counter(lengths).items())

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths with this sum, the longer one as long as possible."""
        low = np.arange(1, total // 2 + 1)
        good = (self.left[low] > 0) & (self.left[total - low] > 0)
        if total % 2 == 0 and len(low):
            good[-1] = self.left[total // 2] >= 2
        found = np.flatnonzero(good)
        return (total - int(low[found[0]]), int(low[found[0]])) if len(found) else None

    def exact(self, gap: int, taken: int) -> tuple[int, ...] | None:
        """One, two or three lengths with this sum, beside one piece of length ``taken``."""
        self.left[taken] -= 1
        try:
            if self.left[gap]:
                return (gap,)
            if two := self.pair(gap):
                return two
            have = self.left[: gap + 1] > 0
            sums = np.convolve(have, have)[: gap + 1] > 0
            for x in np.flatnonzero(have[1:] & sums[gap - np.arange(1, gap + 1)])[::-1] + 1:
                self.left[x] -= 1
                rest = self.pair(gap - int(x))
                self.left[x] += 1
                if rest:
                    return (int(x), *rest)
            return None
        finally:
            self.left[taken] += 1

    def take(self, lengths: tuple[int, ...]) -> Fill:
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= n * times
        return Fill(lengths, times)


def plan(counts: dict[int, int], size: int = SIZE) -> list[Fill]:
    """Combinations and how often each is used; together they use every piece once."""
    have = Counts(counts, size)
    fills = []
    for length in range(size, 0, -1):  # exact fills
        while have.left[length]:
            rest = () if length == size else have.exact(size - length, length)
            if rest is None:
                break
            fills.append(have.take((length, *rest)))
    for length in range(size, 0, -1):  # best fit for what is left
        while have.left[length]:
            chosen, need, gap = [length], Counter([length]), size - length
            while gap:
                fit = np.flatnonzero(have.left[1 : gap + 1])[::-1] + 1
                nxt = next((int(x) for x in fit if have.left[x] > need[int(x)]), 0)
                if not nxt:
                    break
                chosen.append(nxt)
                need[nxt] += 1
                gap -= nxt
            fills.append(have.take(tuple(chosen)))
    return fills


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        names = [c.split()[0] for c in _PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            for first, ids, counts in encoder(path).encode_column(batch.column(1)):
                data, ends, out = memoryview(ids.tobytes()), np.cumsum(4 * counts).tolist(), []
                for doc_id, begin, end in zip(batch.column(0).slice(first, len(ends)).to_pylist(), [0, *ends], ends):
                    total = (end - begin) // 4 + 1  # with the end token
                    for piece, start in enumerate(range(0, total, size)):
                        length = min(size, total - start)
                        last = start + length == total
                        crc = zlib.crc32(data[begin + 4 * start : begin + 4 * (start + length - last)])
                        out.append((doc_id, piece, start, length, zlib.crc32(b"\0\0\0\0", crc) if last else crc, part, int(seen[length])))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _place(fills: list[Fill], size: int):
    """Rows of (length, first rank, past rank, first sequence, offset) as arrays by length."""
    starts = np.zeros(size + 1, np.int64)
    by: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for fill in fills:
        offset = 0
        for length in fill.lengths:
            by.setdefault(length, []).append((int(starts[length]), sequence, offset))
            starts[length] += fill.times
            offset += length
        sequence += fill.times
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                first, sequences, offsets = table[length]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                seq[rows], off[rows] = sequences[at] + ranks[rows] - first[at], offsets[at]
            yield batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return run


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, size: int = SIZE, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    pieces = scratch.keep(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, size), _PIECES))
    counts = scratch.keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # There are parts x lengths of these, so they are never sent to every executor.
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "rank")
    return columns.mapInArrow(_place(plan(total, size), size), schema)
