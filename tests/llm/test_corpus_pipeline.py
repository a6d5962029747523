"""The pipeline against plain versions of its stages, on the smallest tables."""

import corpus_pipeline as p
from hopweave.llm import quality_classifier, secrets_scan
from hopweave.llm.scratch import Scratch
from tests.llm import brute
from tests.llm.test_tokens import check_packing, reference

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, labels, Scratch(spark, "t")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    near = brute.near_duplicates(rows, 80)
    rows = [r for r in rows if near[r[0]][2]]
    hit = brute.contamination(rows, items)
    rows = [r for r in rows if not hit[r[0]][4]]
    want = {}
    for doc_id, text in rows:
        spans = brute.secrets(text)
        for start, end in reversed(merged(spans)):
            text = text[:start] + "[secret]" + text[end:]
        want[doc_id] = text
    out = p.run(spark, DIR).collect()
    assert {r.doc_id for r in out} == set(want)
    check_packing(out, dict(zip(want, reference("word_bpe_49k.json", list(want.values())))))


def merged(spans):
    out = []
    for start, _, end in spans:
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert len(p.STAGES) == 5
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, DIR).schema.simpleString() == docs.schema.simpleString()


def test_secret_stage_only_changes_rows_with_spans(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = {r.doc_id: len(r.secret_spans) for r in secrets_scan.find(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in p.redact_secrets(spark, docs, DIR).collect():
        assert (r.text == before[r.doc_id]) == (found[r.doc_id] == 0) and r.n_chars == len(r.text)
