"""The stages of the pipeline on the smallest supplied tables, and the registered names."""

import os

import pytest

import corpus_pipeline
from repoloom.llm import decontaminate, line_dedup, near_dedup, oracles, quality_classifier, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(oracles.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    before = docs
    for k, (name, function) in enumerate(corpus_pipeline.STAGES[:4]):
        after = function(spark, before, SF_DIR)
        rows = [tuple(r) for r in after.collect()]
        assert after.columns == docs.columns and rows
        left = {r[0]: r for r in rows}
        given = {r["doc_id"]: r for r in before.collect()}
        if k == 0:
            want = {r["doc_id"] for r in quality_classifier.select(before, labels).filter("kept").collect()}
        elif k == 1:
            kept = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in line_dedup.deduplicate(before).collect()}
            want = {i for i, (n, text) in kept.items() if not n or text.strip(" ")}
            assert all(left[i][1] == kept[i][1] for i in want)
        elif k == 2:
            want = {r["doc_id"] for r in near_dedup.near_duplicates(before, 80).filter("kept").collect()}
        else:
            want = {r["doc_id"] for r in decontaminate.judge(before, benchmark).filter("not contaminated").collect()}
        assert set(left) == want <= set(given), name
        before = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, before, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(0 <= r["offset"] and r["offset"] + r["length"] <= 4096 for r in rows)
