"""Near-duplicate documents: SetSketch registers, banding, joint likelihood estimates, then exact sets.

A document's set is its distinct runs of five lower-cased words (the whole sequence as one if shorter). Two documents
are linked when 100 * intersection >= percent * union. Documents of equal sets form one class and only classes are
compared, so copies cost nothing. A register is the truncated, exponentially spaced minimum of one hash; registers of
unions are maxima. Four registers make a band, 32 bands a sketch: at similarity 0.85 a pair shares no band with
probability 6e-11, at 0.8 with 4e-8.

Two passes find the links. In each band's bucket the member that shares the most buckets of all is compared with the
others: by the likelihood of the similarity under both register vectors, then by exact sets. Components follow. Buckets
that still hold several components go through the second pass, grouped by their largest component: members outside it
meet the group's members of fitting set size, in cells of a bounded number of elements, where exact intersections of all
pairs come from matrix products. A cell returns pairs of components that it links, never pairs of documents, so nothing
grows with the square of a group but multiplications. After that every pair of a bucket has been decided: nothing is
capped or left to a further round.

Nulls and empty texts have empty sets and no links. A row with a null doc_id is returned with a null component_id and
kept. Repeated rows are linked as equal texts; each row is returned. Rows of one doc_id with different texts count as
linked, and join the groups that their texts belong to; its rows without words stay by themselves. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopweave.llm.components import components
from hopweave.llm.hashing import byte_list, mix, window_hashes, word_hashes
from hopweave.llm.scratch import Scratch

WORDS = 5
REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A candidate whose estimate is this much below the threshold is dropped: over five standard deviations (0.032 at 0.85).
MARGIN = 0.17
CELL_ROWS, CELL_ITEMS = 1024, 1 << 19  # most sets on either side of a cell, and about so many elements in them
BROADCAST_IDS = 1 << 21  # up to so many ids of candidates go to every executor (under 100 MB); more are joined by exchange
SLICE_BYTES = 2 << 20  # texts that are split into words at once

_seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32)
_A, _B = _seeds[:REGISTERS] | np.uint32(1), _seeds[REGISTERS:]


def shingle_sets(texts: list[bytes], width: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.lower().split() for t in texts]
    hashed = word_hashes([w for words in split for w in words])
    at = 0
    for words in split:
        own = hashed[at : at + len(words)]
        at += len(words)
        yield np.unique(window_hashes(own, min(width, len(own)))) if len(own) else own


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, each of one text or of few bytes."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > SLICE_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def registers(elements: np.ndarray) -> np.ndarray:
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    small = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 512):
        grid = small[at : at + 512, None] * _A
        grid += _B
        np.minimum(low, grid.min(axis=0), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood of the similarity, row by row, for sets of known sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return likeliest(more, less, n_a, n_b)


def likeliest(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    equal = REGISTERS - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    scale, log_b = (BASE - 1) / BASE, np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.clip(u - v * j, 0, 1) * scale) / log_b
        q = -np.log1p(-np.clip(v - u * j, 0, 1) * scale) / log_b
        return more * np.log(p + 1e-12) + less * np.log(q + 1e-12) + equal * np.log(np.clip(1 - p - q, 0, 1) + 1e-12)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = value(x) > value(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_list(batch.column("text"))
        for begin, end in slices(texts):
            known: dict[bytes, int] = {}
            places = [known.setdefault(t, len(known)) for t in texts[begin:end]]  # copies side by side are sketched once
            sizes, digests, regs = [], [], []
            for s in shingle_sets(list(known)):
                sizes.append(len(s))
                if len(s):
                    with np.errstate(over="ignore"):
                        digests.append(np.array([mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s * np.uint64(3)))], np.uint64).tobytes())
                    regs.append(registers(s).tobytes())
                else:
                    digests.append(None)
                    regs.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(begin, end - begin),
                    batch.column("h").slice(begin, end - begin),
                    pa.array([sizes[p] for p in places], pa.int64()),
                    pa.array([digests[p] for p in places], pa.binary()),
                    pa.array([regs[p] for p in places], pa.binary()),
                ],
                names=["doc_id", "h", "n", "digest", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_list(batch.column(1))
        for begin, end in slices(texts):
            sets = [s.tobytes() for s in shingle_sets(texts[begin:end])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sets, pa.binary())], names=["rep", "items"])


def _views(column: pa.Array) -> list[np.ndarray]:
    """Each value's 64-bit elements, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset) // 8
    items = np.frombuffer(data, np.uint64, int(at[-1])) if data is not None and len(column) else np.zeros(0, np.uint64)
    return [items[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                good = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(_views(batch.column(2)), _views(batch.column(3))):
                if len(one) < len(two):
                    one, two = two, one
                shared = int((one[np.searchsorted(one, two).clip(max=len(one) - 1)] == two).sum())
                good.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left set with every right one: elements that many right sets hold by products of 0/1
    matrices, the others by their lists of holders."""
    width = len(right)
    items, place, holders = np.unique(np.concatenate(right), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(width), [len(r) for r in right])
    order = np.argsort(place, kind="stable")
    lists, begins = owner[order], np.cumsum(holders) - holders
    common = holders > max(8, width // 16)
    column = np.cumsum(common) - 1
    right_common = common[place]
    right_row, right_column = owner[right_common], column[place[right_common]]
    out = np.zeros((len(left), width), np.float32)
    for top in range(0, len(left), 128):
        some = left[top : top + 128]
        own, row = np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
        at = np.searchsorted(items, own).clip(max=len(items) - 1)
        hit = items[at] == own
        at, row = at[hit], row[hit]
        rare = ~common[at]
        n, first = holders[at[rare]], begins[at[rare]]
        if len(n):
            flat = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cells = np.repeat(row[rare], n) * width + lists[flat]
            out[top : top + len(some)] += np.bincount(cells, minlength=len(some) * width).reshape(len(some), width)
        row, at = row[~rare], column[at[~rare]]
        for begin in range(0, int(column[-1]) + 1, 4096):
            a, b = np.zeros((len(some), 4096), np.float32), np.zeros((width, 4096), np.float32)
            use = (at >= begin) & (at < begin + 4096)
            a[row[use], at[use] - begin] = 1
            use = (right_column >= begin) & (right_column < begin + 4096)
            b[right_row[use], right_column[use] - begin] = 1
            out[top : top + len(some)] += a @ b.T
    return out


def _linked(cell: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of components that a cell links: its outside sets against its other ones."""
    out = cell.column("outside").to_numpy(zero_copy_only=False).astype(bool)
    comps = cell.column("component").to_numpy()
    sets = [v for chunk in cell.column("items").chunks for v in _views(chunk)]
    one, two = np.flatnonzero(out), np.flatnonzero(~out)
    found = np.zeros((0, 2), np.int64)
    if len(one) and len(two):
        sizes = np.array([len(s) for s in sets], np.float64)
        shared = shared_counts([sets[i] for i in one], [sets[i] for i in two])
        good = 100 * shared >= percent * (sizes[one][:, None] + sizes[two][None, :] - shared)
        good &= comps[one][:, None] != comps[two][None, :]
        x, y = np.nonzero(good)
        found = np.unique(np.stack([comps[one[x]], comps[two[y]]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])


def _cells(percent: int):
    """The rows of a cell follow each other; one cell is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "s", "i", "j"))))
            begin = 0
            for at in range(len(keys) + 1):
                if at == len(keys) or keys[at] != last:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    if at < len(keys):
                        if held:
                            yield _linked(pa.Table.from_batches(held), percent)
                        held, last, begin = [], keys[at], at
        if held:
            yield _linked(pa.Table.from_batches(held), percent)

    return run


def _across(placed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """placed: (key, rep, component). Pairs of components that any link inside a bucket joins."""
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("g"), F.count(F.lit(1)).alias("parts"))
    groups = placed.join(counts.where("parts > 1").select("key", "g"), "key").select("g", "rep", "component").distinct()
    step = np.log(100 / percent) * 1.0001  # linked sets lie in the same or the next class of sizes
    sized = groups.join(sketches.select("rep", F.expr(f"int(floor(ln(n) / {step}D))").alias("class")), "rep")
    spread = sized.withColumn("outside", F.col("component") != F.col("g")).withColumn("s", F.expr("explode(array(class - 1, class, class + 1))"))
    counted = spread.groupBy("g", "s").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.expr("outside AND s = class")).alias("outsiders")).where("outsiders > 0")
    bound = f"greatest(16, least({CELL_ROWS}, int({CELL_ITEMS} / exp(s * {step}D))))"
    dealt = counted.select("g", "s", F.expr(f"int(ceil(outsiders / {bound}))").alias("rows"), F.expr(f"int(ceil(members / {bound}))").alias("columns"))
    with_sets = spread.join(dealt, ["g", "s"]).join(sets, "rep")
    side = "named_struct('outside', {out}, 'i', {i}, 'j', {j})"
    mine = side.format(out="false", i="x", j="int(pmod(xxhash64(rep), columns))")
    theirs = side.format(out="true", i="int(pmod(xxhash64(rep, 1), rows))", j="x")
    cells = with_sets.select(
        "g", "s", "component", "items",
        F.expr(f"explode(concat(transform(sequence(0, rows - 1), x -> {mine}), CASE WHEN outside AND s = class THEN transform(sequence(0, columns - 1), x -> {theirs}) ELSE array() END))").alias("side"),
    ).select("g", "s", "side.i", "side.j", "side.outside", "component", "items")
    # A number of partitions of our own: cells are few bytes and much work, which Spark would put into one task.
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["g", "s", "i", "j"]
    return cells.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_cells(percent), "a long, b long")


def _by_doc_id(worded: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes that share a doc_id, from the least class of each such doc_id to its others."""
    several = worded.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    held = worded.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest")
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def link_classes(docs: DataFrame, scratch: Scratch, percent: int = 85, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest) of each row and (digest, component) of each class of equal non-empty sets."""
    least = percent / 100 - MARGIN
    texted = docs.select("doc_id", F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    rows = scratch.keep(texted.mapInArrow(_sketch, "doc_id long, h long, n long, digest binary, regs binary"))
    worded = rows.where("n > 0 AND doc_id IS NOT NULL")
    # A class goes by a number of its own, as one doc_id may have texts of several classes; its set comes from one of its rows.
    chosen = worded.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = scratch.keep(chosen.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("row.doc_id").alias("least"), F.col("row.h").alias("h"), "n", "regs"))
    bands = REGISTERS // BAND
    keyed = classes.select("rep", F.expr(f"explode(transform(sequence(0, {bands - 1}), j -> xxhash64(j, substring(regs, {2 * BAND} * j + 1, {2 * BAND}))))").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.keep(keyed.join(sizes, "key"))
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    sketches = scratch.keep(classes.select("rep", "n", "regs").join(weights, "rep"))
    wanted = classes.select("rep", F.col("least").alias("doc_id"), "h").join(sketches.select("rep"), "rep", "left_semi")
    if sketches.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = texted.join(wanted, ["doc_id", "h"])
    sets = scratch.keep(texts.groupBy("rep").agg(F.first("text").alias("text")).mapInArrow(_sets, "rep long, items binary"))

    hubs = members.join(sketches.select("rep", "weight"), "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("a"))
    star = members.join(hubs, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    first, second = (sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}")) for c in ("a", "b"))
    sketched = star.join(second, "b").join(first, "a").where(f"least(n_a, n_b) * 100 >= {percent} * greatest(n_a, n_b)")
    likely = scratch.keep(sketched.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely(least), "a long, b long"))
    first, second = (sets.select(F.col("rep").alias(c), F.col("items").alias(f"items_{c}")) for c in ("a", "b"))
    links = scratch.keep(likely.join(second, "b").join(first, "a").select("a", "b", "items_a", "items_b").mapInArrow(_confirm(percent), "a long, b long").unionByName(_by_doc_id(worded, classes)))

    found = scratch.keep(components(links, scratch))
    placed = members.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = scratch.keep(placed)
    joined = scratch.keep(_across(placed, sketches, sets, percent))
    for table in (members, sketches, sets, likely, links, placed):
        scratch.drop(table)
    merged = components(joined, scratch).select(F.col("node").alias("component"), F.col("component").alias("top"))
    named = classes.select("digest", "least", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "least", F.coalesce("component", "rep").alias("component"))
    result = scratch.keep(named.join(merged, "component", "left").select("digest", "least", F.coalesce("top", "component").alias("component")))
    tops = result.groupBy("component").agg(F.min("least").alias("top"))
    result = scratch.keep(result.join(tops, "component").select("digest", F.col("top").alias("component")))
    return rows.select("doc_id", "n", "digest"), result


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    rows, classes = link_classes(docs, scratch, percent, text)
    joined = rows.join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
