"""Importance resampling: features by hand, planted documents, exact selection."""

import random

import numpy as np
import pytest

from repoloom.llm import quality_classifier as qc
from samples import frame, prose


def test_features_count_once_per_text():
    data = np.frombuffer(b"Word word WORD other" + b"word", dtype=np.uint8)
    owner, one, two = qc.features(data, np.array([0, 20, 24]))
    words = [(o, a, b) for o, a, b in zip(owner, one, two) if a < qc.WORD_BUCKETS]
    assert sorted(o for o, _, _ in words) == [0, 0, 1]
    assert {(a, b) for o, a, b in words if o == 1} <= {(a, b) for o, a, b in words if o == 0}
    assert len(set(zip(owner, one))) == len(owner)


@pytest.mark.parametrize("k", [1, 2, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(900)] + [5] * 100
    rows = spark.createDataFrame([(v,) for v in values], "q long")
    assert qc.kth_largest(rows, "q", k) == sorted(values, reverse=True)[k - 1]


def planted(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        text = prose(rng, 60)
        kind = "toxic" if k % 12 == 0 else "loud" if k % 12 == 1 else "clean"
        if kind == "toxic":
            text += " foulword uglyword"
        if kind == "loud":
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((k, text))
        labels.append((k, int(kind != "loud"), int(kind == "toxic")))
    return rows, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")


def test_planted_documents(spark):
    rows, labels = planted(spark)
    found = {r["doc_id"]: r for r in qc.select(frame(spark, rows + [(900, None), (901, "")]), labels).collect()}
    bad = [k for k in range(600) if k % 12 < 2]
    assert sum(found[k]["kept"] for k in bad) <= 1
    assert sum(found[k]["kept"] for k in range(600) if k % 12 >= 2) >= 0.98 * 500
    # The selection is the exact top k of the noisy weights.
    k = round(sum(np.exp(r["log_weight"]) for r in found.values()))
    best = sorted((r["noisy_weight"] for r in found.values()), reverse=True)[:k]
    assert sorted((r["noisy_weight"] for r in found.values() if r["kept"]), reverse=True) == best
    assert found[900]["log_weight"] == found[901]["log_weight"] == 0


def test_without_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a b"), (None, "c"), (2, "a b"), (2, "a b")])
    assert all(r["kept"] for r in qc.select(docs, none).collect())
    assert qc.select(frame(spark, []), none).count() == 0
    kept = qc.keep_selected(docs, none)
    assert kept.count() == 4 and kept.columns == docs.columns


def test_labelled_rows_are_bounded(spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(None, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert qc.good_labels(labels, 20).count() == 20
