import random

from hopweave.llm import byte_shards as b, queries
from hopweave.llm.scratch import Scratch
from tests.llm import brute


def test_documents_match_brute_force(spark):
    dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir}/documents.parquet").collect()]
    out = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in queries.op4_byte_shards(spark, dir).collect()}
    assert {d: x[:3] for d, x in out.items()} == {d: x[:3] for d, x in brute.shards(docs).items()}
    for k in range(24):
        assert sorted(x[3] for x in out.values() if x[2] == k) == list(range(sum(x[2] == k for x in out.values())))
    sizes = [sum(x[0] for x in out.values() if x[2] == k) for k in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(x[0] for x in out.values())


def test_a_group_with_a_third_of_all_rows_and_small_cells(spark, monkeypatch):
    monkeypatch.setattr(b, "CELL_ROWS", 20)
    rng = random.Random(1)
    rows = [(i * 7 - 500, "hot text" if i % 3 == 0 else None if i == 1 else "" if i == 2 else "x" * rng.randrange(200) + str(rng.randrange(300))) for i in range(1500)]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")
    out = b.assign(frame, Scratch(spark, "t4")).collect()
    want = brute.shards(rows)
    assert {r.doc_id: (r.size, r.shard) for r in out} == {d: (x[0], x[2]) for d, x in want.items()}
    for k in range(24):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    sizes = [sum(r.size for r in out if r.shard == k) for k in range(24)]
    assert max(sizes) < 1.1 * sum(sizes) / 24


def test_edge_rows(spark):
    frame = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    out = b.assign(frame, Scratch(spark, "t4")).collect()
    assert len(out) == 4 and all(0 <= r.shard < 24 for r in out)
    assert b.assign(frame.limit(0), Scratch(spark, "t4")).count() == 0


def test_ids_that_lie_far_apart(spark):
    ends = [-(1 << 63), -(1 << 62), 0, (1 << 62) + 5, (1 << 63) - 1]
    rows = [(d, "one text") for d in ends] + [(i, "one text") for i in range(1, 200)] + [(None, "one text")]
    out = b.assign(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t4")).collect()
    assert len(out) == len(rows)
    for k in range(24):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))] == [None, *sorted(d for d, _ in rows if d is not None)]


def test_columns_of_inner_names_and_large_cells_below_the_bound(spark, monkeypatch):
    monkeypatch.setattr(b, "CELL_ROWS", 10)
    rows = [(i if i % 2 else None, "copy" if i < 150 else f"text {i} " * 400, f"r{i}", i, True) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string, _key int, _hot boolean").withColumn("row", b.F.lit("own"))
    seen = []
    numbered = b._numbered
    monkeypatch.setattr(b, "_numbered", lambda split, *more: seen.append(split.groupBy("shard", "_cell", "_step").count().agg({"count": "max"}).first()[0]) or numbered(split, *more))
    out = b.assign(frame, Scratch(spark, "t4")).collect()
    assert sorted((r._row, r._key, r._hot, r.row, r.text) for r in out) == sorted((r[2], r[3], r[4], "own", r[1]) for r in rows)
    assert seen[0] <= 40 and len({r.shard for r in out if r.text == "copy"}) == 1
    for k in range(24):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
