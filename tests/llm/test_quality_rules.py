"""Rules on rows at the edges; the query itself is compared with its SQL."""

from hopweave.llm import quality_rules as q

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(spark, rows, schema="doc_id long, text string"):
    return q.judge(spark.createDataFrame(rows, schema)).collect()


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for ids in at.values() if len(ids) > 1 for i in ids for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_null_empty_long_and_repeated_rows(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b a b a b a", "x\n\nx\nx ", "# * $ % & | < > é日 \x85 \xa0", "w1 w2 w3 " * 100_000, " ".join(f"w{i}" for i in range(60_000)), "the same row", "the same row"]
    out = judge(spark, list(enumerate(texts)))
    assert len(out) == len(texts)
    for r in out:
        n = tuple(r[c] for c in COUNTS)
        assert n == plain(r.text), r.doc_id
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)


def test_empty_table_null_id_and_clashing_names(spark):
    schema = "doc_id long, text string, _t string, _w int, _s double, n_words string, kept int, own_0 string"
    assert judge(spark, [], schema) == []
    (r,) = judge(spark, [(None, "one two", "t", 5, 0.5, "old", 9, "mine")], schema)
    assert (r.doc_id, r._t, r._w, r._s, r.own_0, r.n_words, r.kept) == (None, "t", 5, 0.5, "mine", 2, False)
