"""Product codes of vectors: each of the equal parts of a vector becomes the index of the nearest entry of a codebook.

Components become integers, so that sums and distances are exact and no order of adding matters. Each round sends a
kd-tree for each codebook to the tasks. A task takes a batch of parts down to one leaf each and then visits, by branch
and bound, every node whose box is no farther than the best entry so far; boxes at the same distance are visited too, so
that of equally near entries the lowest index is found. Tasks return sums and counts of entries, which are added up.

Rows whose vector is null or empty, holds null or non-finite components, or cannot be cut into the parts are dropped;
so are those of another length than the vector of the smallest vec_id (a null vec_id comes last). Entries are the parts
of the first rows by vec_id (rows of one vec_id in a fixed order of their vectors); with fewer rows the codebook is shorter. Repeated rows are coded
each, other columns are not read, and an empty table gives an empty one. Components so large that squared distances leave
the whole numbers of a double are held as Python integers, which is slow and exact; an error beyond a long is its maximum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopweave.llm.scratch import Scratch

LEAF, CHUNK, SALTS = 16, 8192, 64
LONG_MAX = (1 << 63) - 1


@dataclass
class Node:
    low: np.ndarray  # the box of the entries below
    high: np.ndarray
    entries: np.ndarray | None  # indexes, ascending, of a leaf
    axis: int = 0
    cut: float = 0
    left: "Node | None" = None
    right: "Node | None" = None


def build(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """Halves at the median of the widest axis, down to leaves of LEAF entries."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    low, high = own.min(axis=0), own.max(axis=0)
    wide = high - low
    axis = int(np.argmax(wide))
    if len(index) <= LEAF or wide[axis] == 0:
        return Node(low, high, np.sort(index))
    order = index[np.argsort(own[:, axis], kind="stable")]
    half = len(order) // 2
    return Node(low, high, None, axis, entries[order[half], axis], build(entries, order[:half]), build(entries, order[half:]))


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


class Nearest:
    """Entries nearest to many points at once."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.norms, self.root = entries, _squares(entries), build(entries)

    def _try(self, leaf: Node, points: np.ndarray, norms: np.ndarray, which: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Takes over the entries of a leaf that are nearer, or as near and of lower index."""
        own = leaf.entries
        far = norms[which][:, None] - 2 * (points[which] @ self.entries[own].T) + self.norms[own][None, :]
        k = far.argmin(axis=1)  # the first of equal ones, and the leaf's indexes ascend
        least, index = far[np.arange(len(which)), k], own[k]
        better = (least < best[which]) | ((least == best[which]) & (index < at[which]))
        best[which[better]], at[which[better]] = least[better], index[better]

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point."""
        norms = _squares(points)
        best = np.full(len(points), np.inf, points.dtype)
        at = np.full(len(points), len(self.entries))
        waiting = [(self.root, np.arange(len(points)))]
        while waiting:  # each point to the leaf on its side of every cut
            node, which = waiting.pop()
            if not len(which):
                continue
            if node.entries is not None:
                self._try(node, points, norms, which, best, at)
            else:
                low = points[which, node.axis] < node.cut
                waiting += [(node.left, which[low]), (node.right, which[~low])]
        waiting = [(self.root, np.arange(len(points)))]
        while waiting:
            node, which = waiting.pop()
            own = points[which]
            gap = np.maximum(np.maximum(node.low - own, own - node.high), 0)
            which = which[_squares(gap) <= best[which]]
            if not len(which):
                continue
            if node.entries is None:
                waiting += [(node.left, which), (node.right, which)]
            else:
                self._try(node, points, norms, which, best, at)
        return at, best


def exact(matrix: np.ndarray, reach: float) -> np.ndarray:
    """The matrix in a type that holds every squared distance among components up to ``reach`` exactly."""
    if matrix.shape[1] * 4 * reach * reach < 2.0**53:
        return matrix
    out = np.empty(matrix.shape, object)
    out[...] = [[int(x) for x in row] for row in matrix.tolist()]
    return out


def _cut(rows: list[bytes], parts: int, reach: float) -> list[np.ndarray]:
    """Vectors as a matrix for each part."""
    matrix = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    width = matrix.shape[1] // parts
    return [exact(matrix[:, k * width : (k + 1) * width], reach) for k in range(parts)]


def _read(rows, parts: int, reach: float) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in rows:
        for begin in range(0, batch.num_rows, CHUNK):
            some = batch.slice(begin, CHUNK)
            yield some, _cut(some.column("ints").to_pylist(), parts, reach)


def _sums(shared, parts: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Nearest(e) for e in shared.value]
        total: dict[tuple[int, int], list] = {}
        for _, points in _read(batches, parts, reach):
            for p, (own, tree) in enumerate(zip(points, trees)):
                index, _ = tree.search(own)
                order = np.argsort(index, kind="stable")
                found, first, n = np.unique(index[order], return_index=True, return_counts=True)
                for e, sums, more in zip(found.tolist(), np.add.reduceat(own[order], first, axis=0).tolist(), n.tolist()):
                    have, count = total.get((p, e), ([0] * len(sums), 0))
                    total[p, e] = [a + int(b) for a, b in zip(have, sums)], count + more
        rows = [(p, e, pos, str(x), n) for (p, e), (sums, n) in total.items() for pos, x in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["part", "entry", "pos", "total", "n"])

    return run


def _codes(shared, parts: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Nearest(e) for e in shared.value]
        for rows, points in _read(batches, parts, reach):
            found = [tree.search(own) for own, tree in zip(points, trees)]
            index = np.stack([i for i, _ in found], axis=1)
            error = [min(LONG_MAX, sum(int(x) for x in far)) for far in zip(*(d.tolist() for _, d in found))]
            code = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(code), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        n = batch.num_rows
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
        ints = np.floor(values * 1024.0)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in ints], pa.binary()), pa.array(np.abs(ints).max(axis=1) if n else [], pa.float64())], names=["vec_id", "label", "ints", "reach"])


def encode(vectors: DataFrame, scratch: Scratch, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("an index takes two hex digits")
    types = dict(vectors.dtypes)
    good = F.expr(f"embedding IS NOT NULL AND size(embedding) > 0 AND size(embedding) % {parts} = 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    clean = vectors.select("vec_id", "embedding", "label").where(good)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long, label_error long, codebooks_sha256 string"
    first = clean.select("vec_id", F.size("embedding").alias("n")).agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "n")).alias("m")).first()["m"]
    if first is None:
        return spark.createDataFrame([], schema).drop("label")
    kept = scratch.keep(clean.where(F.size("embedding") == first["n"]).mapInArrow(_quantised, f"vec_id {types['vec_id']}, label {types['label']}, ints binary, reach double"))
    reach = kept.agg(F.max("reach")).first()[0]
    seeds = kept.select("vec_id", F.col("ints")).orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    books = _cut([bytes(r["ints"]) for r in seeds], parts, reach)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = kept.select("ints").mapInArrow(_sums(shared, parts, reach), "part int, entry int, pos int, total string, n long")
        added = sums.groupBy("part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("n").alias("n")).collect()  # a row a component of the codebooks at most
        books = [b.copy() for b in books]
        for r in added:
            books[r["part"]][r["entry"], r["pos"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)
    coded = scratch.keep(kept.mapInArrow(_codes(shared, parts, reach), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"))
    scratch.drop(kept)
    # The sums of labels meet a hot label's rows in several tasks: each sum goes along once for each salt.
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    sums = sums.select("label", F.least("s", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = coded.withColumn("salt", F.expr(f"int(pmod(xxhash64(vec_id, code), {SALTS}))"))
    joined = salted.join(sums, salted["label"].eqNullSafe(sums["label"]) & (salted["salt"] == sums["salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
