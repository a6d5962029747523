import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hopweave.llm import packing, queries, repair_files
from hopweave.llm.scratch import Scratch
from hopweave.llm.tokens import ChunkEncoder

ODD = ["", " ", "\n\n", " a", "a ", "a\n", "don't  stop\n\n  it's", "a\tb \t c", "x y z", "<|endoftext|> hi <|startoftext|>", "Ünïcode ΑΣ Σ́ é Å K", "a \x1c b", "日本語 テキスト 123 4,567", "!!! ... ### a.b", " ́x", "ok\r\nwindows"]


def reference(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab Zé\n.'s1#\t ") for _ in range(60)) for _ in range(300)]
    out = ChunkEncoder(public_tokenizers.path(name)).encode([*texts, None])
    assert [np.frombuffer(x, "<u4").tolist() for x in out] == [*reference(name, texts), []]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_random_texts(name, monkeypatch):
    """20,000 texts of letters that change their length in lower case, marks, white space of all kinds and special tokens."""
    monkeypatch.setattr("hopweave.llm.tokens.MEMO_BYTES", 1 << 16)
    rng = random.Random(11)
    bits = [*"abZé.,;:?!'s1#İıǅßΣςÅǰ\u0301\u0307\u0130\u1e9e\u212b  \n\n\t\r\x0b\x0c\x1c\x85\xa0\u200a\u2028\u3000\u200b\ufeff日한😀", "İ.", "İ, ", "don't", "<|endoftext|>", "<|startoftext|>", "'ll ", "...", "  ", "word"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(20_000)]
    out = ChunkEncoder(public_tokenizers.path(name)).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in out] == reference(name, texts)


def test_slices_of_a_column(monkeypatch):
    monkeypatch.setattr("hopweave.llm.tokens.SLICE_BYTES", 40)
    test_chunks_give_the_ids_of_whole_texts("byte_bpe_50k.json")


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    phrases = rng.integers(0, 40000, (30, 8))
    documents = [np.append(phrases[rng.integers(0, 30, n)], 0).astype(np.uint32) for n in (0, 1, 700, 3, 2500)] + [np.append(np.full(3001, 7), 0).astype(np.uint32)]
    shard = repair_files.Shard(repair_files.pack(np.concatenate(documents), np.array([len(d) for d in documents]), 50257))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, documents)) // 2
    assert all(np.array_equal(shard.document(i), d) for i, d in enumerate(documents))
    assert shard.token_counts().tolist() == [len(d) for d in documents]
    assert repair_files.Shard(repair_files.pack(np.zeros(0, np.uint32), np.zeros(0, np.int64), 50257)).all() == []


def test_grammar_ends_only_when_no_pair_pays():
    rng = np.random.default_rng(6)
    ids = np.where(rng.random(400_000) < 0.01, 0, np.minimum(rng.zipf(1.2, 400_000), 40_000)).astype(np.uint32)
    symbols, rules = repair_files.grammar(ids, 50257)
    s = symbols.astype(np.int64)
    keep = (s[:-1] != 0) & (s[1:] != 0)
    pairs, counts = np.unique((s[:-1] << 32 | s[1:])[keep], return_counts=True)
    assert counts.max() < repair_files.MIN_USES or np.all((pairs >> 32 == pairs & 0xFFFFFFFF)[counts >= repair_files.MIN_USES])
    assert 50257 + len(rules) > 0 and not (rules == 0).any() and len(symbols) < len(ids)
    shard = repair_files.Shard(repair_files.pack(ids, np.array([len(ids)]), 50257))
    assert np.array_equal(shard.expand(shard.symbols), ids)


def test_op3_matches_plain_encoding(spark):
    dir = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{dir}/documents.parquet").collect())
    want, start = {}, 0
    for (doc_id, _), ids in zip(rows, reference("byte_bpe_50k.json", [t for _, t in rows])):
        ids = np.array([*ids, 0], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_repair_files(spark, dir).collect()} == want


def test_op3_edge_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    schema = "doc_id long, text string, part int, file string"
    rows = [(3, None, 1, "x"), (1, "", 1, "x"), (2, "long " * 60000, 1, "x"), (2, "again", 1, "x"), (None, "null id", 1, "x")]
    out = repair_files.read_shards(repair_files.write_shards(spark.createDataFrame(rows, schema), Scratch(spark, "t3"), path)).collect()
    assert len(out) == 5 and {r.doc_id for r in out} == {None, 1, 2, 3} and sorted(r.n_tokens for r in out)[:2] == [1, 1]
    spans = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    empty = repair_files.write_shards(spark.createDataFrame([], schema), Scratch(spark, "t3"), path)
    assert repair_files.read_shards(empty).count() == 0


def check_packing(rows, want_ids, size=2048):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, ids in want_ids.items():
        ids, own = np.array([*ids, 0], "<u4"), sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range((len(ids) + size - 1) // size))
        for r in own:
            assert r.start == r.piece * size and r.length == min(size, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return len(by_sequence)


def test_op8_is_a_tight_packing(spark):
    dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{dir}/documents.parquet").collect()}
    rows = queries.op8_best_fit_packing(spark, dir).collect()
    n = check_packing(rows, dict(zip(docs, reference("word_bpe_49k.json", list(docs.values())))))
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_op8_edge_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, text string, length string, part int"
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "word " * 9000, "a", 1), (4, "x", "a", 1), (4, "x", "a", 1), (None, "y", "a", 1)]
    out = packing.pack(spark.createDataFrame(rows, schema), Scratch(spark, "t8"), path).collect()
    assert len(out) == 5 + 5 and sum(r.length for r in out) == 9001 + 2 + 2 * 3
    assert packing.pack(spark.createDataFrame([], schema), Scratch(spark, "t8"), path).count() == 0


def test_plan_uses_each_piece_once_and_few_sequences():
    rng = np.random.default_rng(4)
    for _ in range(5):
        lengths = np.minimum(2048, rng.lognormal(6, 1, 3000).astype(int) + 1)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        fills, used = packing.plan(counts), {}
        for f in fills:
            assert sum(f.lengths) <= 2048 and f.times > 0
            for x in f.lengths:
                used[x] = used.get(x, 0) + f.times
        assert used == counts
        assert sum(f.times for f in fills) <= 1.01 * np.ceil(lengths.sum() / 2048) + 1
