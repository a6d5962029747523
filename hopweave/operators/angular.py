"""Exact neighbours by angle: pivots cut the vectors into cells, and a vector is sent only to cells that can hold a neighbour.

With d the angle, w a member of the cell of pivot p (its nearest pivot) and q a vector within r of w, the triangle
inequality gives d(q, p) <= r + the cell's greatest d(w, p), d(q, p) >= its least d(w, p) - r, and, as p is nearest to w,
d(q, p) <= 2 r + d(q, q's own pivot). Inside a cell members lie by their angle to the pivot, and q meets those within r of
its own. What is met is compared by matrix products. How much that saves depends on the data: vectors at right angles to
one another all stay candidates at wide radii, clusters do not.

For a threshold, r is the same for all. For the k nearest, a first pass over each vector's own cell finds k neighbours;
the worst of them is its r. Pivots are a bounded sample; cells and the vectors sent to them are dealt out in blocks of
about BLOCK_ROWS on either side, however full a cell is. Where nearly all vectors would be sent to nearly all cells, vectors
are not copied: blocks of them meet where they are read, and a task passes on only the k best of each asker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hopweave.sources.shared import keep

BLOCK_ROWS = 2048
SENT_ROWS, SENT_BYTES = 2048, 16 << 20  # vectors looked at, and bytes of their copies that leave a task, at a time
MOST_PIVOTS, CELL_ROWS = 256, 256
MOST_COPIES, MOST_SHARE = 8, 0.25  # of a vector, and of all pairs that meet: beyond both, nothing is sent to cells
MET_BYTES = 128 << 20  # of vectors that a task reads again for each block of askers
SLACK = 2e-6  # scores are rounded to six places; angles near 0 and pi are the most sensitive to that


def _unit(batch, at: int = 1):
    import numpy as np

    m = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.maximum(size, 1e-300), size[:, 0] > 0


def _angles(unit, pivots):
    import numpy as np

    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _placed(pivots):
    """Unit vectors with their cell and the angle to its pivot; vectors of length 0 are in a cell of their own."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit, real = _unit(batch)
                angle = _angles(unit, pivots)
                cell = np.where(real, angle.argmin(axis=1), len(pivots)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(cell), pa.array(np.where(real, angle.min(axis=1), 0.0))], names=["id", "unit", "cell", "angle"]
                )

    return run


def _sent(pivots, low, high, own_only: bool, counts_only: bool):
    """Each row once for every cell that can hold a neighbour at its bound, or how many rows each cell is sent."""
    import numpy as np
    import pyarrow as pa

    n = len(pivots)

    def run(batches):
        total = np.zeros(n + 1, np.int64)
        for batch in (whole.slice(at, SENT_ROWS) for whole in batches for at in range(0, whole.num_rows, SENT_ROWS)):
            unit = np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(batch.num_rows, -1)
            cell, bound = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            angle = _angles(unit, pivots)
            r = np.arccos(np.clip(bound - SLACK, -1.0, 1.0))[:, None] + 1e-6
            if own_only:
                met = np.arange(n + 1)[None, :] == cell[:, None]
            else:
                met = np.ones((len(cell), n + 1), bool)
                near = (angle <= high[None, :n] + r) & (angle >= low[None, :n] - r) & (angle <= angle.min(axis=1, keepdims=True) + 2 * r)
                met[:, :n] = near | (cell == n)[:, None]
            met &= (high >= 0)[None, :]
            if counts_only:
                total += met.sum(axis=0)
                continue
            row, to = np.nonzero(met)
            away = np.concatenate([angle, np.zeros((len(cell), 1))], axis=1)[row, to]
            # A vector may go to every cell: the copies leave in parts of a few MB.
            for at in range(0, len(row), step := max(1, SENT_BYTES // unit[0].nbytes)):
                take = pa.array(row[at : at + step])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("unit").take(take), batch.column("bound").take(take), pa.array(to[at : at + step].astype(np.int32)), pa.array(away[at : at + step])], names=["id", "unit", "bound", "cell", "angle"])
        if counts_only:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    return run


def _nearest(k: int, n_pivots: int):
    import numpy as np
    import pandas as pd

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": left["id"].iloc[:0], "dst": right["id"].iloc[:0], "score": np.zeros(0)})]
        if len(left) and len(right):
            left, right = left.sort_values(["angle", "id"]), right.sort_values(["angle", "id"])
            q, w = (np.frombuffer(b"".join(x["unit"])).reshape(len(x), -1) for x in (left, right))
            asker, names, a_q, a_w, bound = left["id"].to_numpy(), right["id"].to_numpy(), left["angle"].to_numpy(), right["angle"].to_numpy(), left["bound"].to_numpy()
            r = np.arccos(np.clip(bound - SLACK, -1.0, 1.0)) + 1e-6
            if left["cell"].iloc[0] == n_pivots:
                r = np.full(len(q), np.pi)  # no angle to vectors of length 0
            r = np.where((q != 0).any(axis=1), r, np.pi)
            # So many askers at a time that the scores stay within a few MB.
            for at in range(0, len(q), step := max(1, 500_000 // len(w))):
                own = slice(at, at + step)
                begin, end = np.searchsorted(a_w, (a_q[own] - r[own]).min()), np.searchsorted(a_w, (a_q[own] + r[own]).max(), side="right")
                score = np.round(q[own] @ w[begin:end].T, 6)
                i, j = np.nonzero((score >= bound[own, None]) & (asker[own][:, None] != names[None, begin:end]))
                order = np.lexsort((names[begin + j], -score[i, j], i))  # ties go to the smaller id
                i, j = i[order], j[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[best], j[best]
                out.append(pd.DataFrame({"src": asker[own][i], "dst": names[begin + j], "score": score[i, j]}))
        return pd.concat(out)

    return run


def _packed(batches):
    """Rows (id, unit, bound) as rows of up to BLOCK_ROWS vectors each."""
    import pyarrow as pa

    for batch in (whole.slice(at, BLOCK_ROWS) for whole in batches for at in range(0, whole.num_rows, BLOCK_ROWS)):
        lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(c)])) for c in ("id", "bound")]
        yield pa.RecordBatch.from_arrays([lists[0], pa.array([b"".join(batch.column("unit").to_pylist())], pa.binary()), lists[1]], names=["ids", "units", "bounds"])


def _best(k: int, id_kind):
    """The k best of each asker among the blocks that its own block meets in this task; a block's rows come together."""
    import numpy as np
    import pyarrow as pa

    def cut(found):
        i, names, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((names, -score, i))  # ties go to the smaller id
        i, names, score = i[order], names[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[best], names[best], score[best]

    def ids_of(row):
        return row.values.to_numpy(zero_copy_only=False)

    def out(asker, found):
        i, names, score = cut(found) if found else ([], [], [])
        for at in range(0, len(i), 100_000):
            some = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(asker[i[some]], id_kind), pa.array(names[some], id_kind), pa.array(score[some])], names=["src", "dst", "score"])

    def run(batches):
        now, asker, found, pending = None, None, [], 0
        for batch in batches:
            block, ids, units, bounds, others, far = (batch.column(c) for c in ("block", "ids", "units", "bounds", "others", "far"))
            for n in range(batch.num_rows):
                if block[n].as_py() != now:
                    yield from out(asker, found)
                    now, found, pending = block[n].as_py(), [], 0
                    asker, bound = ids_of(ids[n]), ids_of(bounds[n]).copy()
                    q = np.frombuffer(units[n].as_py()).reshape(len(asker), -1)
                names = ids_of(others[n])
                w = np.frombuffer(far[n].as_py()).reshape(len(names), -1)
                for at in range(0, len(q), step := max(1, 500_000 // len(w))):
                    own = slice(at, at + step)
                    score = np.round(q[own] @ w.T, 6)
                    i, j = np.nonzero(score >= bound[own, None])
                    other = asker[own][i] != names[j]
                    i, j = i[other], j[other]
                    found.append((at + i, names[j], score[i, j]))
                    pending += len(i)
                if pending > 500_000:
                    found, pending = [cut(found)], 0
                    i, _, score = found[0]
                    full = np.flatnonzero(np.bincount(i, minlength=len(bound)) == k)
                    bound[full] = np.maximum(bound[full], score[np.searchsorted(i, full, side="right") - 1])
        yield from out(asker, found)

    return run


def _all_met(asked: DataFrame, members: DataFrame, n_asked: int, n: int, size: int, k: int, schema: str, id_type: str) -> DataFrame:
    """The k best of each asker in each part of MET_BYTES of the members, by a Cartesian product of blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    pack = lambda df: df.mapInArrow(_packed, f"ids array<{id_type}>, units binary, bounds array<double>")
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_asked // BLOCK_ROWS))
    left = pack(asked.select("id", "unit", "bound").repartition(tasks)).withColumn("block", F.monotonically_increasing_id())
    right = pack(members.select("id", "unit", F.lit(0.0).alias("bound")).repartition(max(1, -(-n * size // MET_BYTES))))
    both = keep(left).repartition(tasks, "block").crossJoin(keep(right).select(F.col("ids").alias("others"), F.col("units").alias("far")).repartition(max(1, -(-n * size // MET_BYTES))).hint("shuffle_replicate_nl"))
    return both.mapInArrow(_best(k, to_arrow_type(members.schema["id"].dataType)), schema)


def _joined(sent_from: DataFrame, members: DataFrame, cells: dict, pivots, k: int, own_only: bool, schema: str, id_type: str, report: Callable[[dict], None] | None, total: int) -> DataFrame:
    import numpy as np

    low, high = (np.array([cells.get(c, {}).get(f, -1.0) for c in range(len(pivots) + 1)]) for f in ("low", "high"))
    counted = sent_from.mapInArrow(_sent(pivots, low, high, own_only, True), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell
    asked = {r["cell"]: r["n"] for r in counted}
    blocks = lambda n: F.array(*[F.lit(max(1, -(-n(c) // BLOCK_ROWS))) for c in range(len(pivots) + 1)])
    per_cell = lambda n: F.element_at(blocks(n), F.col("cell") + 1)
    n_left, n_right = (lambda c: asked.get(c, 0)), (lambda c: cells.get(c, {}).get("n", 0))
    if report:
        met = sum(n_left(c) * n_right(c) for c in range(len(pivots) + 1))
        report({"pivots": len(pivots), "share_met": met / max(1, total)})
    copies = sum(n_left(c) * max(1, -(-n_right(c) // BLOCK_ROWS)) for c in range(len(pivots) + 1))
    n_asked = total // max(1, sum(n_right(c) for c in range(len(pivots) + 1)))
    if not own_only and copies > MOST_COPIES * n_asked and sum(n_left(c) * n_right(c) for c in range(len(pivots) + 1)) > MOST_SHARE * total:
        return _all_met(sent_from, members, n_asked, sum(map(n_right, range(len(pivots) + 1))), pivots[0].nbytes, k, schema, id_type)
    spread = lambda df, n: F.explode(F.sequence(F.lit(0), per_cell(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), per_cell(n)).cast("int")
    q = sent_from.mapInArrow(_sent(pivots, low, high, own_only, False), f"id {id_type}, unit binary, bound double, cell int, angle double")
    q = q.withColumn("qb", deal(n_left, 0)).withColumn("wb", spread(q, n_right))
    w = members.withColumn("wb", deal(n_right, 1)).withColumn("qb", spread(members, n_left))
    keys = ("cell", "qb", "wb")
    return q.groupBy(*keys).cogroup(w.groupBy(*keys)).applyInPandas(_nearest(k, len(pivots)), schema)


def neighbours(vectors: DataFrame, k: int, least: float | None = None, queries: DataFrame | None = None, report: Callable[[dict], None] | None = None) -> DataFrame:
    """(src, dst, score, rank): for each row of queries (vec_id, embedding; all vectors without it), the at most k others of
    the greatest cosine, of at least ``least`` where given. A vec_id stands for one vector; rows without a vector are left out,
and a vector of length 0 has cosine 0 with all. Scores are rounded to six places, ties go to the smaller id.
    ``report`` is called with the number of pivots and the share of all pairs that met in a cell."""
    import numpy as np

    id_type = dict(vectors.dtypes)["vec_id"]
    schema = f"src {id_type}, dst {id_type}, score double"
    rows = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL")
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(MOST_PIVOTS, n // CELL_ROWS))).collect()  # at most MOST_PIVOTS
    pivots = np.array([r["embedding"] for r in chosen], float)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    place = lambda df: df.mapInArrow(_placed(pivots), f"id {id_type}, unit binary, cell int, angle double")
    members = keep(place(rows))
    asked = members if queries is None else keep(place(queries.select("vec_id", "embedding").where("embedding IS NOT NULL")))
    total = n * (n if queries is None else asked.count())
    stats = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # a row a cell
    cells = {r["cell"]: {"n": r["n"], "low": r["low"], "high": r["high"]} for r in stats}
    rank: Column = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    if least is None:
        lowest = F.lit(-2.0)
        first = _joined(asked.withColumn("bound", lowest), members, cells, pivots, k, True, schema, id_type, None, total)
        ranked = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("src").alias("id"), F.col("score").alias("bound"))
        bounded = keep(asked.join(ranked, "id", "left").select("id", "unit", "cell", "angle", F.coalesce("bound", lowest).alias("bound")))
    else:
        bounded = asked.withColumn("bound", F.lit(float(least)))
    pairs = _joined(bounded, members, cells, pivots, k, False, schema, id_type, report, total)
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
