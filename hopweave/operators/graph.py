"""Knowledge-graph operators over triples (chunk, subj, pred, obj): edges, frequencies, neighbours, PageRank, deletes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hopweave.functions.numeric import norm
from hopweave.operators import angular
from hopweave.sources.shared import forget, kept_by


def bridge(triples: DataFrame, asked: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct (entity, chunk): read from either side it is the inverted map of the other. asked: a test of the entities
    that the caller joins, so that no others are exchanged."""
    named = triples.select("chunk", F.explode(F.array("subj", "obj")).alias("entity"))
    return (named if asked is None else named.where(asked(F.col("entity")))).distinct()


def fact_edges(triples: DataFrame) -> DataFrame:
    """Directed (src, dst, weight): triple occurrences counted both ways, no self loops. Pairs are counted once, in the order
    of their names, and turned into both directions after the exchange."""
    pairs = triples.where("subj <> obj").groupBy(F.least("subj", "obj").alias("a"), F.greatest("subj", "obj").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(both).alias("e"), "weight").select("e.src", "e.dst", "weight")


def passage_edges(triples: DataFrame) -> DataFrame:
    return bridge(triples).select(F.col("chunk").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight"))


def entity_idf(triples: DataFrame, asked: Callable[[Column], Column] | None = None) -> DataFrame:
    """df and ln((N + 1) / (df + 1)) + 1, N the number of chunks. asked: as in bridge; N is that of all chunks."""
    pairs = bridge(triples, asked)
    # One row; where all entities are asked for, from the exchange that both share.
    total = (pairs if asked is None else triples).select("chunk").distinct().agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(F.broadcast(total)).select("entity", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def fact_documents(triples: DataFrame) -> DataFrame:
    """Chunks of each distinct fact."""
    return triples.groupBy("subj", "pred", "obj").agg(F.countDistinct("chunk").alias("n_chunks"))


def merge_edges(facts: DataFrame, synonyms: DataFrame, policy: str = "overwrite") -> DataFrame:
    """Synonym score over fact count for the same directed pair, or the greater of both."""
    both = facts.withColumnRenamed("weight", "fact_weight").join(synonyms.withColumnRenamed("weight", "syn_weight"), ["src", "dst"], "full")
    weight = F.coalesce("syn_weight", "fact_weight") if policy == "overwrite" else F.greatest("syn_weight", "fact_weight")
    return both.select("src", "dst", weight.cast("double").alias("weight"))


def neighbours(edges: DataFrame, idf: DataFrame, top: int = 32) -> DataFrame:
    """Distinct neighbours by idf / (1 + degree), then name."""
    pairs = edges.select("src", "dst").distinct()
    degree = pairs.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("degree"))
    scored = pairs.join(degree, "dst").join(idf.select(F.col("entity").alias("dst"), "idf"), "dst").withColumn("score", F.round(F.col("idf") / (1 + F.col("degree")), 6))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("src", "dst", "score", "rank")


def bridge_neighbours(triples: DataFrame, top: int = 32) -> DataFrame:
    """neighbours of the graph of triples, every distinct triple an edge both ways.

    Both directions are dealt out once, by node, with the chunk: there lie a node's distinct neighbours, which give its
    degree, and its distinct chunks, which give its idf. A node's score is its own affair, so it goes on to each node next to
    it, as a whole number of millionths."""
    ends = F.array(F.struct(F.col("subj").alias("node"), F.col("obj").alias("other")), F.struct(F.col("obj").alias("node"), F.col("subj").alias("other")))
    sides = triples.select("chunk", F.explode(ends).alias("e")).select("e.node", "e.other", "chunk").repartition("node")
    df = sides.select("node", "chunk").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("df"))
    total = triples.select("chunk").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    pairs = sides.where("node <> other").select("node", "other").distinct().withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("node")))
    score = F.round((F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1) / (1 + F.col("degree")), 6)
    sent = pairs.join(df, "node").join(F.broadcast(total)).select(F.col("other").alias("src"), F.col("node").alias("dst"), F.round(score * 1e6).cast("int").alias("millionths"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("millionths"), "dst"))
    return sent.withColumn("rank", rank).where(F.col("rank") <= top).select("src", "dst", (F.col("millionths") / 1e6).alias("score"), "rank")


def knn(vectors: DataFrame, k: int, least: float | None = None, queries: DataFrame | None = None, report=None) -> DataFrame:
    """Cosine neighbours (src, dst, score, rank) of each query row (vec_id, embedding) among all vectors, itself left out."""
    return angular.neighbours(vectors, k, least, queries, report)


def synonym_edges(vectors: DataFrame, least: float = 0.8, at_most: int = 101, labels: DataFrame | None = None) -> DataFrame:
    """Directed synonym edges; labels (vec_id, label), where given, bar short ones from asking."""
    from hopweave.functions.text import short_label

    asked = vectors if labels is None else vectors.join(labels.where(~short_label(F.col("label"))), "vec_id", "left_semi")
    return knn(vectors, at_most, least, asked).select("src", "dst", F.col("score").alias("weight"))


BLOCK_BYTES, SCORED_BYTES = 8 << 20, 1 << 20  # of query vectors that go along with a task, and with one that holds their best
SCORES, OUT_ROWS = 250_000, 100_000  # products held at a time, and rows that leave a task at a time


def _query_blocks(queries: DataFrame, most: int = BLOCK_BYTES):
    """(ids, matrix) of the query set, a bounded number of vectors at a time."""
    import numpy as np

    ids, held, size = [], [], 0
    for r in queries.select("query_id", "embedding").toLocalIterator():
        ids.append(r[0])
        held.append(r[1])
        size += 8 * len(r[1])
        if size >= most:
            yield ids, np.array(held, float)
            ids, held, size = [], [], 0
    if ids:
        yield ids, np.array(held, float)


def _products(ids: list, matrix, top: int | None, names: list[str]):
    import numpy as np
    import pyarrow as pa

    def best(keys, score):
        """Rows of score by falling score and then key, the first ``top`` of each; -inf is no row."""
        order = np.argsort(keys, kind="stable")
        keys, score = keys[order], score[:, order]
        at = np.argsort(-score, axis=1, kind="stable")[:, : top or None]
        return keys[at], np.take_along_axis(score, at, axis=1)

    def run(batches):
        low, high, kept, asked = np.full(len(ids), np.inf), np.full(len(ids), -np.inf), None, pa.array(ids)

        def out(keys, score):
            for at in range(0, len(score), step := max(1, OUT_ROWS // max(1, score.shape[1]))):
                q, j = np.nonzero(np.isfinite(score[at : at + step]))
                q += at
                columns = [asked.take(pa.array(q)), pa.array(keys[q, j]), pa.array(score[q, j]), pa.array(low[q]), pa.array(high[q])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0).to_pylist())
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
            for begin in range(0, len(keys), step := max(1, SCORES // len(ids))):
                score = np.round(matrix @ values[begin : begin + step].T, 6)
                low, high = np.minimum(low, score.min(axis=1)), np.maximum(high, score.max(axis=1))
                some = np.broadcast_to(keys[begin : begin + step], score.shape)
                if top is None:
                    yield from out(some, score)
                elif kept is None:
                    kept = best(keys[begin : begin + step], score)
                else:  # the best so far and the best of these
                    more = best(keys[begin : begin + step], score)
                    both, scores = np.concatenate([kept[0], more[0]], axis=1), np.concatenate([kept[1], more[1]], axis=1)
                    at = np.stack([np.lexsort((k, -s))[:top] for k, s in zip(both, scores)])
                    kept = np.take_along_axis(both, at, axis=1), np.take_along_axis(scores, at, axis=1)
        if kept is not None:
            yield from out(*kept)

    return run


def dense_scores(queries: DataFrame, passages: DataFrame, top: int | None = None, key: str = "vec_id") -> DataFrame:
    """(query_id, key, raw, score, rank): inner products scaled within each query by all of its products.

    Blocks of the query set go along with the tasks that read the rows, a matrix product for each Arrow batch; a task sends
    only its ``top`` rows of each query, with the least and greatest product it has seen."""
    types = dict(queries.dtypes) | dict(passages.dtypes)
    rows, names = passages.select(key, "embedding"), ["query_id", key, "raw", "low", "high"]
    schema = f"query_id {types['query_id']}, {key} {types[key]}, raw double, low double, high double"
    found = passages.sparkSession.createDataFrame([], schema)
    for ids, matrix in _query_blocks(queries, SCORED_BYTES):
        found = found.unionByName(rows.mapInArrow(_products(ids, matrix, top, names), schema))
    w = Window.partitionBy("query_id")
    low, high = (F.min("low").over(w), F.max("high").over(w)) if top is not None else (F.min("raw").over(w), F.max("raw").over(w))
    scaled = found.select("query_id", key, "raw", F.when(high == low, 1.0).otherwise((F.col("raw") - low) / (high - low)).alias("score"))
    ranked = scaled.withColumn("rank", F.row_number().over(w.orderBy(F.desc("raw"), key)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def dense_blocks(queries: DataFrame, passages: DataFrame, ids: list, width: int, key: str = "vec_id") -> DataFrame:
    """(block, key, raw): inner products of every row of passages with the queries ids[block * width], ..., as one array a
    row and block; rounded as in dense_scores."""
    import numpy as np
    import pyarrow as pa

    kind = dict(passages.dtypes)[key]
    schema = f"block int, {key} {kind}, raw array<double>"
    place = {q: i for i, q in enumerate(ids)}
    found = passages.sparkSession.createDataFrame([], schema)

    def products(blocks: dict):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                for block, (at, matrix) in blocks.items():
                    raw = np.full((batch.num_rows, width), np.nan)
                    raw[:, at] = np.round(values @ matrix.T, 6)
                    cells = pa.array(np.where(np.isnan(raw), 0.0, raw).ravel(), mask=np.isnan(raw).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), cells)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block, np.int32)), batch.column(0), lists], names=["block", key, "raw"])

        return run

    for some, matrix in _query_blocks(queries.where(F.col("query_id").isNotNull()).orderBy("query_id")):
        where = np.array([place[q] for q in some])
        blocks = {int(b): (where[where // width == b] % width, matrix[where // width == b]) for b in np.unique(where // width)}
        found = found.unionByName(passages.select(key, "embedding").mapInArrow(products(blocks), schema))
    return found


def scaled_blocks(blocks: DataFrame, width: int, keep, factor: float = 1.0) -> DataFrame:
    """dense_blocks with columns r0, r1, ... in place of the array: each query's products, scaled between its least and its
    greatest one, times a factor. The extremes are a row a block, found by partial aggregation."""
    kept = keep(blocks)
    raw = [F.get("raw", F.lit(i)) for i in range(width)]
    ends = kept.groupBy("block").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(raw) for f, n in ((F.min, "low"), (F.max, "high"))])
    scale = lambda i, c: F.when(F.col(f"high{i}") == F.col(f"low{i}"), 1.0).otherwise((c - F.col(f"low{i}")) / (F.col(f"high{i}") - F.col(f"low{i}")))
    others = [c for c in blocks.columns if c != "raw"]
    return kept.join(F.broadcast(ends), "block").select(*others, *[F.coalesce(factor * scale(i, c), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(raw)])


def node_key(label: Column) -> Column:
    """A 128-bit name of a node: short in a shuffle, and too long to collide."""
    return F.unhex(F.md5(label))


def transition(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, p): both directions of each row, weights over out-strength."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    summed = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    strength = summed.groupBy("src").agg(F.sum("weight").alias("out"))
    return summed.join(strength, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p"))


QUERIES_AT_ONCE = 32


def personalised_pagerank(edges: DataFrame, reset: DataFrame, damping: float | dict = 0.5, steps: int = 20, keep=None, report=None) -> DataFrame:
    """All queries at once: reset (query_id, node, weight) and the K-step power iteration x = d * P x + (1 - d) * r.

    damping: one for all queries, or by query_id. NaN and negative reset weights count as 0; resets are scaled to sum 1.
    The mass of nodes without edges returns by their query's reset. ``report``, where given, is called with the last
    change: the sum of |x_K - x_(K-1)| over nodes, the greatest of all queries.

    A node's row holds a column for each of up to 32 queries, so an edge is read once a step and not once for each query.
    ``keep`` writes a table after every step and so cuts lineage. With it, edges lie in buckets of their source, and a step
    exchanges nothing but sums by node.
    """
    clean = F.when(F.isnan("weight") | (F.col("weight") < 0) | F.col("weight").isNull(), 0.0).otherwise(F.col("weight"))
    total = Window.partitionBy("query_id")
    r = reset.select("query_id", "node", clean.alias("w")).groupBy("query_id", "node").agg(F.sum("w").alias("w"))
    r = r.select("query_id", "node", (F.col("w") / F.sum("w").over(total)).alias("r")).where("r > 0")
    moves = transition(edges)
    if keep:
        r = keep(r)
    ids = [row.query_id for row in r.select("query_id").distinct().orderBy("query_id").collect()]  # the query set, one value each
    scores, changes = r.select("query_id", "node", F.col("r").alias("score")).limit(0), []
    with kept_by(moves, "src") if keep else contextlib.nullcontext(moves) as moves:
        for i in range(0, len(ids), QUERIES_AT_ONCE):
            found = _iterate(moves, r, ids[i : i + QUERIES_AT_ONCE], damping, steps, keep, changes if report else None)
            scores = scores.unionByName(keep(found) if keep else found)
    if changes:
        report(max(changes))
    return scores


def _iterate(moves: DataFrame, r: DataFrame, ids: list, damping: float | dict, steps: int, keep, changes: list | None) -> DataFrame:
    names = [f"x{i}" for i in range(len(ids))]
    d = {n: float(damping[q] if isinstance(damping, dict) else damping) for q, n in zip(ids, names)}
    start = r.groupBy("node").agg(*[F.sum(F.when(F.col("query_id").eqNullSafe(F.lit(q)), F.col("r")).otherwise(0.0)).alias(n) for q, n in zip(ids, names)])
    back = start.select("node", *[((1 - d[n]) * F.col(n)).alias(n) for n in names])
    x = start
    for step in range(1, steps + 1):
        spread = x.join(moves, x.node == moves.src).select(F.col("dst").alias("node"), *[(d[n] * F.col("p") * F.col(n)).alias(n) for n in names])
        if step > 1:
            forget(before)
        before, x = x, spread.unionByName(back).groupBy("node").agg(*[F.sum(n).alias(n) for n in names])
        if keep:
            x = keep(x)
    if changes is not None and steps:
        gap = lambda n: F.sum(F.abs(F.coalesce(f"new.{n}", F.lit(0.0)) - F.coalesce(f"old.{n}", F.lit(0.0))))
        both = x.alias("new").join(before.alias("old"), F.col("new.node") == F.col("old.node"), "full")
        changes.append(max(both.agg(*[gap(n).alias(n) for n in names]).first()))
    lost = x.agg(*[(1 - F.sum(n)).alias(f"lost_{n}") for n in names])  # one row: what nodes without edges did not pass on
    resets = start.select("node", *[F.col(n).alias(f"r_{n}") for n in names])
    whole = x.join(resets, "node", "left").join(F.broadcast(lost))
    cell = lambda q, n: F.struct(F.lit(q).cast(r.schema["query_id"].dataType).alias("query_id"), F.col(n).alias("x"), (F.col(n) + F.coalesce(f"r_{n}", F.lit(0.0)) * F.col(f"lost_{n}")).alias("score"))
    cells = whole.select("node", F.explode(F.array(*[cell(q, n) for q, n in zip(ids, names)])).alias("c"))
    return cells.where("c.x > 0").select("c.query_id", "node", "c.score")


def delete_chunks(triples: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples that stay, and entities that no staying chunk names."""
    stay = triples.join(gone.select("chunk").distinct(), "chunk", "left_anti")
    # Both sides of the question in one pass: chunks meet once, and what entities exchange is a flag from each task.
    marked = triples.select("chunk", "subj", "obj").join(gone.select("chunk").distinct().withColumn("_gone", F.lit(True)), "chunk", "left")
    named = marked.select(F.explode(F.array("subj", "obj")).alias("entity"), F.coalesce("_gone", F.lit(False)).alias("_gone"))
    return stay, named.groupBy("entity").agg(F.bool_and("_gone").alias("_gone")).where("_gone").select("entity")


def known_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges without self loops whose ends are both vertices."""
    v = vertices.select("node").distinct()
    return edges.where("src <> dst").join(v.withColumnRenamed("node", "src"), "src", "left_semi").join(v.withColumnRenamed("node", "dst"), "dst", "left_semi")


def edge_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Edges that differ: missing, unexpected or of another weight."""
    both = expected.select("src", "dst", F.col("weight").alias("expected")).join(actual.select("src", "dst", F.col("weight").alias("actual")), ["src", "dst"], "full")
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("actual"), "weight")
    return both.withColumn("issue", kind).where("issue IS NOT NULL")


def missing_ids(new: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    return new.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def prune(store: DataFrame, current: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.join(current.select(key).distinct(), key, "left_semi")


def vector_audit(vectors: DataFrame, dimension: int, tolerance: float = 0.02) -> DataFrame:
    bad_norm = F.abs(norm(F.col("embedding")) - 1) > tolerance
    not_finite = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"), F.count_if(F.size("embedding") != dimension).alias("bad_dimension"),
        F.count_if(not_finite).alias("not_finite"), F.count_if(bad_norm).alias("bad_norm"),
    )


def graph_info(triples: DataFrame) -> DataFrame:
    ents = bridge(triples).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return ents.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("passage_edges"), F.round(F.avg(F.length("entity")), 6).alias("avg_entity_chars"), F.max("n").alias("max_chunks"))


def digests(triples: DataFrame) -> DataFrame:
    """Order-free digest of each chunk's distinct triples."""
    line = F.concat_ws("|", "subj", "pred", "obj")
    return triples.groupBy("chunk").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("digest"))
