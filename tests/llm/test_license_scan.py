from hopweave.llm import license_scan as s, queries
from tests.llm import brute

EDGES = [None, "", "..", "all rights reserved", "ALL rights, reserved. All rights reserved all rights", "cc by cc-by CC BY-SA 4.0", "general public license " * 20000, "ünder the MIT Licenseé", "acc by", "Général public license"]


def labels(text):
    return s.scan(text.encode(), s.gate())[5]


def test_base_matches_brute_force(spark):
    dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{dir}/documents.parquet").collect()}
    out = queries.op7_license_scan(spark, dir).collect()
    assert len(out) == len(docs) and any(r.labels for r in out)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(docs[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_edge_rows(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGES)], "doc_id long, text string, labels string")
    for r in s.find_licenses(frame).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(EDGES[r.doc_id])
    assert s.find_licenses(frame.limit(0)).count() == 0


def test_rules_and_suppression():
    assert len(s.rules()) > 300
    assert labels("Released under the MIT License.") == ["MIT"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0", "gpl"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0", "cc-by"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause"]
    assert labels("the GNU Affero General Public License v3 applies") == ["AGPL-3.0", "gpl"]
    assert labels("summit licensee, nothing here") == []
