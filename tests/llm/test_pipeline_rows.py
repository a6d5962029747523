"""Stages on rows whose doc_id is repeated or null."""

from pyspark.sql import functions as F

import corpus_pipeline as p

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in texts], COLUMNS)


def words(start, n=100):
    return " ".join(f"w{i}" for i in range(start, start + n))


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))


def test_near_duplicates_go_by_row(spark):
    docs = rows_of(spark, [(9, words(0))] * 3 + [(7, words(0)), (5, words(300)), (5, words(600)), (None, words(0)), (None, words(900)), (4, ""), (4, ""), (4, "!"), (3, "")]).repartition(3)
    out = p.drop_near_duplicates(spark, docs, DIR)
    assert ids(out) == [3, 4, 4, 5, 5, 7, None, None]
    assert {r.text for r in out.collect() if r.doc_id == 5} == {words(300), words(600)}


def test_quality_and_contamination_judge_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    good = p.drop_low_quality(spark, docs, DIR)
    kept = {r.doc_id for r in good.collect()}
    bad = docs.where(~F.col("doc_id").isin(*kept))
    one, two = good.orderBy("doc_id").first(), bad.orderBy("doc_id").first()
    more = spark.createDataFrame([(None, *one[1:]), (one[0], *two[1:])], docs.schema)
    out = p.drop_low_quality(spark, docs.unionByName(more), DIR)
    assert out.count() == len(kept) + 1 and out.where("doc_id IS NULL").count() == 1
    mixed = rows_of(spark, [(1, "a clean text"), (1, item), (None, "another clean text"), (None, item)])
    assert sorted(r.text for r in p.drop_contaminated(spark, mixed, DIR).collect()) == ["a clean text", "another clean text"]


def test_stages_pass_odd_rows_and_columns(spark):
    schema = f"{COLUMNS}, _t string, row int, _row int, secret_spans string, rep int, f_symbols double, spans int"
    more = ("t", 1, 2, "s", 3, 0.5, 4)
    long = "it was said in the town that " + words(0, 30_000)
    docs = spark.createDataFrame([(1, words(0), "en", "a", 5, *more), (2, None, None, None, None, *[None] * 7), (3, "", "en", "a", 0, *more), (4, long, "en", "a", 9, *more), (4, long, "en", "a", 9, *more), (None, None, None, None, None, *more)], schema)
    for name, stage in p.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, DIR)
            assert out.schema.simpleString() == docs.schema.simpleString()
            rows = out.collect()
            assert all((r["_t"], r["row"], r["_row"], r["secret_spans"], r["rep"], r["spans"]) in {("t", 1, 2, "s", 3, 4), (None,) * 6} for r in rows), name
            assert rows or frame is not docs
    assert sorted(ids(p.redact_secrets(spark, docs, DIR)), key=str) == [1, 2, 3, 4, 4, None]
    assert ids(p.drop_near_duplicates(spark, docs, DIR)) == [1, 2, 3, 4, None]
    assert ids(p.drop_contaminated(spark, docs, DIR)) == [1, 2, 3, 4, 4, None]
    packed = p.pack_sequences(spark, docs, DIR)
    assert packed.where("piece = 0").count() == 6 and p.pack_sequences(spark, docs.limit(0), DIR).count() == 0
