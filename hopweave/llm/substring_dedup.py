"""Substring deduplication by recompression.

A word is removed when a window of 50 consecutive words covers it whose word sequence also starts in a document with a
smaller doc_id. Windows are judged on the input.

Rounds rename the word sequence: a round merges adjacent pairs (left symbol, right symbol) under a side that each
symbol takes by its name, and one round merges short runs of an equal symbol. Names are 64-bit hashes of content, so
every task gives a pair or run the same name without an exchange. A round can disturb one symbol at either end of a
window, so inside two equal windows the symbols agree but for at most LOSS words at each end; hence equal windows share
a symbol that starts within their first LOSS words, and the WIDTH - LOSS words from there (an anchor) are equal.

Anchors that come in several documents reveal long repeats; only windows around them are compared, by 128-bit hashes.
Documents travel as chunks that one task has read; a chunk sends each hash once with its least and greatest doc_id, so
a passage that a third of all documents share costs one entry a chunk, and a bucket of hashes never holds its copies.

A null text has no words. Rows of equal doc_id are one document here: a repeat among them alone removes nothing. Rows
with a null doc_id are returned unchanged and remove nothing elsewhere. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from hopweave.llm.hashing import MULTIPLIER, byte_list, mix, window_hashes, word_hashes
from hopweave.llm.scratch import Scratch

WIDTH = 50
ROUNDS = ("pairs", "pairs", "runs", "pairs", "pairs")
RUN_WORDS = 4
LOSS = 1 + 2 + RUN_WORDS + 4 + 8  # words at either end of a window that the rounds can disturb
ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF0000)
CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000

TEXTS, HASHES, DONE = 0, 1, 2
_BLOBS = "kind int, bucket int, chunk long, payload binary"


def symbol_starts(words: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Places at which the last round's symbols start; ``document`` parts the sequence."""
    names, starts = words, np.arange(len(words), dtype=np.int64)
    docs = document
    for level, kind in enumerate(ROUNDS):
        salt = np.uint64(level * 0x9E3779B1 + 1)
        if len(names) < 2:
            break
        inside = docs[1:] == docs[:-1]
        gone = np.zeros(len(names), bool)
        if kind == "pairs":
            left = (mix(names + salt) & np.uint64(1)).astype(bool)
            merge = np.flatnonzero(left[:-1] & ~left[1:] & inside)
            names = names.copy()
            names[merge] = mix(names[merge] * MULTIPLIER + names[merge + 1] + salt)
            gone[merge + 1] = True
        else:
            same = (names[1:] == names[:-1]) & inside
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            count = np.diff(np.append(first, len(names)))
            if not (count > 1).any():
                continue
            ends = np.append(starts[1:], len(words))
            length = (ends - starts)[first]
            # A symbol's last place in a document is followed by another document's first, so lengths hold there too.
            short = (count > 1) & (count * length <= RUN_WORDS)
            names = names.copy()
            names[first[short]] = mix(names[first[short]] * MULTIPLIER + count[short].astype(np.uint64) + salt)
            run = np.repeat(np.arange(len(first)), count)
            gone = short[run]
            gone[first] = False
        names, starts, docs = names[~gone], starts[~gone], docs[~gone]
    return starts


class Chunk:
    """Documents of one task with their words as one sequence."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.words = np.array(ids, np.int64), [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.hashes = word_hashes([w for ws in self.words for w in ws])
        self.document = np.repeat(np.arange(len(ids)), self.counts)
        self.ends = (self.begins + self.counts)[self.document] if len(self.document) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        span = WIDTH - LOSS
        starts = symbol_starts(self.hashes, self.document)
        starts = starts[starts + span <= self.ends[starts]]
        return starts, window_hashes(self.hashes, span)[starts] & ANCHOR_BITS  # a false match only costs a comparison

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and 128-bit hashes (two columns) of the windows that hold one of the anchors from its LOSS-th word on."""
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        low = np.maximum(anchors - LOSS, self.begins[self.document[anchors]])
        np.add.at(edge, low, 1)
        np.add.at(edge, anchors + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        starts = starts[starts + WIDTH <= self.ends[starts]]
        other = mix(self.hashes ^ np.uint64(0xA5A5A5A5DEADBEEF))
        return starts, np.stack([window_hashes(self.hashes, WIDTH)[starts], window_hashes(other, WIDTH)[starts]], axis=1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; 8-byte values go plane by plane, so that equal high or low bytes cost nothing."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head + b"".join(planes), 1)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, (kind, columns) in zip(sizes.tolist(), types):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * columns * width, at).reshape(width, -1)
        at += planes.size
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(a.reshape(-1, columns) if columns > 1 else a)
    return out


def _pack_texts(ids: list[int], texts: list[bytes]) -> bytes:
    return _pack(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))


def _unpack_texts(data: bytes) -> tuple[list[int], list[bytes]]:
    ids, sizes, raw = _unpack(data, (np.int64, 1), (np.int64, 1), (np.uint8, 1))
    raw, cuts = raw.tobytes(), np.cumsum(sizes).tolist()
    return ids.tolist(), [raw[a:b] for a, b in zip([0, *cuts], cuts)]


def _done(ids: list, words: list[list[bytes]], keep: list[np.ndarray | None]) -> bytes:
    """Result rows: id, whether it is null, words, removed words, digest of what is kept."""
    digests, removed = [], []
    for ws, k in zip(words, keep):
        digests.append(hashlib.sha256(b" ".join(ws if k is None else [w for w, good in zip(ws, k.tolist()) if good])).digest())
        removed.append(0 if k is None else int(len(k) - k.sum()))
    null = np.array([i is None for i in ids], np.uint8)
    return _pack(np.array([i or 0 for i in ids], np.int64), null, np.array([len(w) for w in words], np.int64), np.array(removed, np.int64), np.frombuffer(b"".join(digests), np.uint8))


def _summed(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (rows) with their least and greatest owner."""
    columns = [keys] if keys.ndim == 1 else [keys[:, 1], keys[:, 0]]
    order = np.lexsort((owners, *columns))
    keys, owners = keys[order], owners[order]
    new = (keys[1:] != keys[:-1]) if keys.ndim == 1 else (keys[1:] != keys[:-1]).any(axis=1)
    first = np.flatnonzero(np.concatenate(([True], new))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.minimum.reduceat(owners, first) if len(first) else owners, np.maximum.reduceat(owners, first) if len(first) else owners


def _blobs(chunk: int, buckets: int, keys: np.ndarray, owners: np.ndarray) -> list[tuple]:
    keys, low, high = _summed(keys, owners)
    lead = keys if keys.ndim == 1 else keys[:, 0]
    bucket = ((lead >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(HASHES, int(bucket[part[0]]), chunk, _pack(keys[part], low[part], high[part])) for part in np.split(order, cuts) if len(part)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, chunks, payloads = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(chunks, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "bucket", "chunk", "payload"]
    )


def _first_visit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            split = [t.split() for t in texts]
            large = [i for i, w in enumerate(split) if len(w) >= WIDTH and ids[i] is not None]
            chosen = set(large)
            small = [i for i in range(len(ids)) if i not in chosen]
            rows = [(DONE, 0, chunk, _done([ids[i] for i in small], [split[i] for i in small], [None] * len(small)))] if small else []
            if large:
                own_ids, own = [ids[i] for i in large], [texts[i] for i in large]
                c = Chunk(own_ids, own)
                places, keys = c.anchors()
                rows += [(TEXTS, 0, chunk, _pack_texts(own_ids, own)), *_blobs(chunk, buckets, keys, c.ids[c.document[places]])]
            return _batch(rows)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield flush()
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()

    return run


def _shared(columns: int, needs_less: bool):
    """Of one bucket: for each chunk the keys that other documents share, with their least owner."""

    def run(table: pa.Table) -> pa.Table:
        chunks, parts = [], []
        for chunk, data in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist()):
            keys, low, high = _unpack(data, (np.uint64, columns), (np.int64, 1), (np.int64, 1))
            chunks.append(np.full(len(low), chunk, np.int64))
            parts.append((keys, low, high))
        chunk = np.concatenate(chunks)
        keys, low, high = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((chunk, keys)) if columns == 1 else np.lexsort((chunk, keys[:, 1], keys[:, 0]))
        keys, low, high, chunk = keys[order], low[order], high[order], chunk[order]
        new = (keys[1:] != keys[:-1]) if columns == 1 else (keys[1:] != keys[:-1]).any(axis=1)
        first = np.flatnonzero(np.concatenate(([True], new)))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        least, most = np.minimum.reduceat(low, first)[group], np.maximum.reduceat(high, first)[group]
        told = np.flatnonzero(least < high if needs_less else least < most)
        told = told[np.argsort(chunk[told], kind="stable")]
        cuts = np.flatnonzero(np.diff(chunk[told])) + 1
        rows = [(int(chunk[p[0]]), _pack(keys[p], least[p])) for p in np.split(told, cuts) if len(p)]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "answer": pa.array([a for _, a in rows], pa.binary())})

    return run


def _answers(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(a, (np.uint64, columns), (np.int64, 1)) for a in table.column("answer").to_pylist()]
    if not parts:
        return np.zeros((0, columns) if columns > 1 else 0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])


def _second_visit(buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        keys = np.sort(_answers(answers, 1)[0])
        for chunk, data in zip(texts.column("chunk").to_pylist(), texts.column("payload").to_pylist()):
            ids, raw = _unpack_texts(data)
            involved = np.zeros(len(ids), bool)
            if len(keys):
                c = Chunk(ids, raw)
                places, own = c.anchors()
                places = places[keys[np.searchsorted(keys, own).clip(max=len(keys) - 1)] == own]
                starts, hashes = c.windows(places)
                involved[np.unique(c.document[starts])] = True
                rows += _blobs(chunk, buckets, hashes, c.ids[c.document[starts]])
            out, left = np.flatnonzero(~involved).tolist(), np.flatnonzero(involved).tolist()
            if out:
                rows.append((DONE, 0, chunk, _done([ids[i] for i in out], [raw[i].split() for i in out], [None] * len(out))))
            if left:
                rows.append((TEXTS, 0, chunk, _pack_texts([ids[i] for i in left], [raw[i] for i in left])))
        return pa.Table.from_batches([_batch(rows)]) if rows else pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})

    return run


def _third_visit(texts: pa.Table, answers: pa.Table) -> pa.Table:
    rows = []
    keys, least = _answers(answers, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, least = keys[order], least[order]
    pairs = np.ascontiguousarray(keys).view([("a", np.uint64), ("b", np.uint64)]).ravel()
    for data in texts.column("payload").to_pylist():
        ids, raw = _unpack_texts(data)
        c = Chunk(ids, raw)
        keep = np.ones(len(c.hashes), bool)
        if len(keys):
            # All windows of these documents are looked up; those that were not sent have no answer.
            firsts = window_hashes(c.hashes, WIDTH)
            at = np.searchsorted(keys[:, 0], firsts).clip(max=len(keys) - 1)
            starts = np.flatnonzero(keys[at, 0] == firsts)
            starts = starts[starts + WIDTH <= c.ends[starts]]
            seconds = window_hashes(mix(c.hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)), WIDTH)[starts]
            own = np.ascontiguousarray(np.stack([firsts[starts], seconds], axis=1)).view(pairs.dtype).ravel()
            at = np.searchsorted(pairs, own).clip(max=len(pairs) - 1)
            hit = starts[(pairs[at] == own) & (least[at] < c.ids[c.document[starts]])]
            edge = np.zeros(len(c.hashes) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WIDTH, -1)
            keep = np.cumsum(edge)[:-1] == 0
        rows.append(_done(ids, c.words, np.split(keep, np.cumsum(c.counts)[:-1])))
    return pa.table({"payload": pa.array(rows, pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            ids, null, words, removed, digests = _unpack(data, (np.int64, 1), (np.uint8, 1), (np.int64, 1), (np.int64, 1), (np.uint8, 1))
            shas = [digests[i : i + 32].tobytes().hex() for i in range(0, len(digests), 32)]
            columns = [pa.array(ids, mask=null.astype(bool)), pa.array(words), pa.array(removed), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    spark = docs.sparkSession
    if buckets is None:  # so many that a bucket of hashes comes from BUCKET_BYTES of text, whatever the input
        size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0]
        buckets = max(16, -(-(size or 0) // BUCKET_BYTES))
    read = lambda path, kind: spark.read.schema("bucket int, chunk long, payload binary, kind int").parquet(path).where(F.col("kind") == kind)

    first = scratch.write(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_first_visit(buckets), _BLOBS), "kind")
    anchors = read(first, HASHES).select("bucket", "chunk", "payload").groupBy("bucket").applyInArrow(_shared(1, False), "chunk long, answer binary")
    answers = scratch.keep(anchors)
    scratch.drop(f"{first}/kind={HASHES}")
    scratch.release()
    texts = read(first, TEXTS).select("chunk", "payload")
    second = scratch.write(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_second_visit(buckets), _BLOBS), "kind")
    scratch.drop(f"{first}/kind={TEXTS}")
    scratch.release()
    windows = read(second, HASHES).select("bucket", "chunk", "payload").groupBy("bucket").applyInArrow(_shared(2, True), "chunk long, answer binary")
    found = scratch.keep(windows)
    scratch.drop(f"{second}/kind={HASHES}")
    scratch.release()
    last = read(second, TEXTS).select("chunk", "payload").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_third_visit, "payload binary")
    done = read(first, DONE).select("payload").unionByName(read(second, DONE).select("payload")).unionByName(last)
    return done.mapInArrow(_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")
