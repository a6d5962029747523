"""Token-id shards compressed by a Re-Pair grammar.

A shard file holds the ids of consecutive documents. Rounds replace the most frequent adjacent id pairs by new symbols;
each symbol is a rule of two earlier ones. A round takes all pairs used at least a sixteenth as often as the most frequent
one, and rounds go on until no pair is used often enough to pay for its rule. Id 0 ends each document and is in no rule,
so a document is a slice of the symbols and can be decoded alone; stored expansion lengths give its token count without
decoding.

Layout, little-endian: magic ``HWR2``, then u32 first nonterminal, u32 rules, u32 documents, u32 symbols; then one
zstandard frame of u32 values: rule pairs, expansion lengths, document ends in symbols, symbols; each list is stored as
four planes, of all lowest bytes, all second bytes and so on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from hopweave.llm.scratch import Scratch
from hopweave.llm.tokens import encoder

MAGIC = b"HWR2"
HEAD = "<4sIIII"
SHARD_TOKENS = 2_000_000
MIN_USES = 12  # a rule takes about as many bytes as it saves at so many uses
SHARE, HASH_BITS = 16, 20


def frequent_pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pairs used at least a SHARE-th as often as the most frequent one (and MIN_USES times), the places of these pairs,
    and which of them stands there. None if no pair is used MIN_USES times."""
    one, two = seq[:-1], seq[1:]
    cell = (one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)
    ends = np.flatnonzero(seq == 0)
    cell[ends[ends < len(cell)]] = cell[ends[ends > 0] - 1] = 1 << HASH_BITS
    uses = np.bincount(cell, minlength=(1 << HASH_BITS) + 1)
    uses[-1] = 0
    bound = max(MIN_USES, int(uses.max()) // SHARE)
    while True:
        heavy = np.flatnonzero((uses >= bound)[cell])
        own = one[heavy].astype(np.int64) << 32 | two[heavy]
        pairs, counts = np.unique(own, return_counts=True)  # exact counts of what may be frequent
        pairs = pairs[counts >= bound]
        if len(pairs):
            at = np.searchsorted(pairs, own).clip(max=len(pairs) - 1)
            hit = pairs[at] == own
            return pairs, heavy[hit], at[hit]
        if bound == MIN_USES:
            return None
        bound = max(MIN_USES, bound // SHARE)  # rare pairs shared a cell


def grammar(seq: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols after all rounds, and the rules (pairs of symbols) in order of creation."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    used = 0
    while len(seq) > 1 and (found := frequent_pairs(seq)):
        pairs, where, which = found
        # Of occurrences that overlap in a chain, every second one is replaced.
        if (np.diff(where) == 1).any():
            fresh = np.concatenate(([True], np.diff(where) > 1))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            even = (np.arange(len(where)) - begin) % 2 == 0
            where, which = where[even], which[even]
        kept = np.bincount(which, minlength=len(pairs)) > 0
        pairs = pairs[kept]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        seq[where] = (first + used + np.cumsum(kept) - 1)[which]
        used += len(pairs)
        stays = np.ones(len(seq), bool)
        stays[where + 1] = False
        seq = seq[stays]
    return seq, np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)


def levels(rules: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rules that only name symbols from before their range."""
    later, done = rules.max(axis=1).astype(np.int64) - first if len(rules) else np.zeros(0, np.int64), 0
    while done < len(rules):
        past = later[done:] >= done
        end = done + (int(past.argmax()) if past.any() else len(past))
        yield done, end
        done = end


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").ravel().view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(ids: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """A shard file of documents' ids, of which each has as many as ``counts`` says."""
    if len(ids) and int(ids.max()) >= first:
        raise ValueError("ids must be below the first nonterminal")
    # An end is told from an equal id inside a text by the stored ends: both are outside every rule.
    symbols, rules = grammar(ids, first)
    lengths = np.ones(first + len(rules), np.int64)
    for begin, end in levels(rules, first):
        lengths[first + begin : first + end] = lengths[rules[begin:end]].sum(axis=1)
    ends = np.searchsorted(np.cumsum(lengths[symbols]), np.cumsum(counts)) + 1
    head = struct.pack(HEAD, MAGIC, first, len(rules), len(counts), len(symbols))
    return head + zstandard.compress(b"".join(map(_planes, (rules, lengths[first:], ends, symbols))), 1)


class Shard:
    """Random access to the documents of a shard file."""

    def __init__(self, data: bytes):
        magic, self.first, rules, self.documents, symbols = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        sizes = [2 * rules, rules, self.documents, symbols]
        body = np.frombuffer(zstandard.decompress(data[struct.calcsize(HEAD) :], max_output_size=max(1, 4 * sum(sizes))), np.uint8)
        parts = [np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel() for p in np.split(body, np.cumsum(sizes)[:-1] * 4)]
        self.rules, self.ends, self.symbols = parts[0].reshape(-1, 2), parts[2].astype(np.int64), parts[3]
        self.lengths = np.concatenate([np.ones(self.first, np.int64), parts[1]])
        # What each symbol stands for, one after the other; places fit 32 bits unless a shard is far larger than usual.
        after = np.cumsum(self.lengths)
        kind = np.int32 if after[-1] < 1 << 31 else np.int64
        self._begins, self.lengths = (after - self.lengths).astype(kind), self.lengths.astype(kind)
        self._flat = np.empty(int(after[-1]), np.uint32)
        self._flat[: self.first] = np.arange(self.first)
        for begin, end in levels(self.rules, self.first):
            part = self.expand(self.rules[begin:end].ravel())
            at = int(self._begins[self.first + begin])
            self._flat[at : at + len(part)] = part

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        if not len(n):
            return np.zeros(0, np.uint32)
        total = np.cumsum(n)
        places = np.repeat((self._begins[symbols] - (total - n)).astype(n.dtype), n)
        places += np.arange(len(places), dtype=n.dtype)
        return self._flat[places]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]])

    def token_counts(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.lengths[self.symbols], dtype=np.int64)])[np.concatenate([[0], self.ends])])

    def all(self) -> list[np.ndarray]:
        counts = self.token_counts()
        return np.split(self.expand(self.symbols), np.cumsum(counts)[:-1]) if len(counts) else []


_SHARD = "part int, shard int, doc_ids array<long>, tokens long, file binary"


def _write(path: str, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, ids, held, lengths, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([pack(np.concatenate(held), np.array(lengths), first)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_ids", "tokens", "file"])

        end = np.zeros(1, np.uint32)
        for batch in batches:
            for at, found, counts in encoder(path).encode_column(batch.column(1)):
                for doc_id, one in zip(batch.column(0).slice(at, len(counts)).to_pylist(), np.split(found, np.cumsum(counts)[:-1])):
                    ids.append(doc_id)
                    held += [one, end]
                    size += len(one) + 1
                    lengths.append(len(one) + 1)
                    if size >= SHARD_TOKENS:
                        yield flush()
                        shard, ids, held, lengths, size = shard + 1, [], [], [], 0
        if ids:
            yield flush()

    return run


def write_shards(docs: DataFrame, scratch: Scratch, tokenizer: str, text: str = "text", first: int = 50257) -> DataFrame:
    """Writes shard files in ascending doc_id order (nulls first) to a table of the shared folder and returns it.

    A null text has only its end. Rows of equal doc_id follow each other. An empty table writes no shard.
    """
    ordered = docs.select("doc_id", F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch.keep(ordered.mapInArrow(_write(tokenizer, first), _SHARD))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, ids, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            shard_file = Shard(data)
            flat, lengths = memoryview(shard_file.expand(shard_file.symbols).astype("<u4", copy=False)).cast("B"), shard_file.token_counts()
            ends = (4 * np.cumsum(lengths)).tolist()
            columns = [
                pa.array([part] * len(ids), pa.int32()), pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                pa.array(np.cumsum(lengths, dtype=np.int64) - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    decoded = shards.select("part", "shard", "doc_ids", "file").mapInArrow(_read, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))
    inner = sizes.select("part", "shard", F.coalesce(F.sum("tokens").over(before.partitionBy("part").orderBy("shard")), F.lit(0)).alias("inner_base"))
    bases = inner.join(parts, "part").select("part", "shard", (F.col("base") + F.col("inner_base")).alias("base"))
    return decoded.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
