import random

import numpy as np
import pytest

from hopweave.llm import vector_codes as v
from hopweave.llm.scratch import Scratch


def plain(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, vector) by vec_id; codes, errors and the final entries, all distances looked at."""
    import math

    cut = [[tuple(math.floor(1024 * x) for x in e[p * len(e) // parts : (p + 1) * len(e) // parts]) for p in range(parts)] for _, e in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda c, p: min((far(c, b), i) for i, b in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(c[p], p)[1] for c in cut] for p in range(parts)]
        books = [
            [tuple(sum(x) // len(m) for x in zip(*m)) if (m := [c[p] for c, o in zip(cut, own[p]) if o == i]) else b for i, b in enumerate(books[p])] for p in range(parts)
        ]
    found = [[near(c[p], p) for p in range(parts)] for c in cut]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found]


def run(spark, rows, label="int", **more):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {label}, entry int, code string")
    return v.encode(frame.repartition(3), Scratch(spark, "t12"), **more)


@pytest.mark.parametrize("points", [np.random.default_rng(1).integers(-9, 9, (500, 3)), np.random.default_rng(2).integers(0, 2, (400, 4)), np.full((50, 2), 7)])
def test_search_finds_the_lowest_of_the_nearest(points):
    points = points.astype(float)
    entries = np.concatenate([points[:60], points[:60]])
    index, far = v.Nearest(entries).search(points)
    all_far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (far == all_far.min(axis=1)).all() and (index == all_far.argmin(axis=1)).all()


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_ties_copies_labels_and_large_components(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.25, 0.5)) * scale + rng.random() * (i % 3 == 0) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # a third are copies
    rng.shuffle(rows)
    got = {r.vec_id: r for r in run(spark, [(i, e, None if i % 3 == 0 else 1, 1, "x") for i, e in rows], entries=40).collect()}
    want = dict(zip(range(420), plain(sorted(rows), entries=40)))
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    sums = {k: sum(want[i][1] for i in want if (i % 3 == 0) == k) for k in (True, False)}
    assert all(r.label_error == min(sums[i % 3 == 0], v.LONG_MAX) for i, r in got.items())
    assert len({r.codebooks_sha256 for r in got.values()}) == 1


def test_rows_that_are_dropped_and_kept(spark):
    good = [float(x) for x in range(8)]
    rows = [(5, good), (5, good), (None, good), (1, None), (2, []), (3, [1.0, None] * 4), (4, [float("nan")] * 8), (6, [float("inf")] + good[1:]), (7, good[:4]), (8, good[:7]), (9, [-0.5] * 8)]
    out = run(spark, [(i, e, None, 1, "x") for i, e in rows], label="string").collect()
    assert sorted((str(r.vec_id), r.error) for r in out) == [("5", 0), ("5", 0), ("9", 0), ("None", 0)]
    assert out[0].code == "00000000" and {r.code for r in out if r.vec_id == 9} == {"02020202"}
    empty = run(spark, [(1, None, 1, 1, "x")])
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert run(spark, []).count() == 0
