"""Hyperdimensional profiles: vectors by hand, held-out accuracy, awkward rows."""

import os
import zlib

import numpy as np
import pytest

from repoloom.llm import language_id
from samples import SCHEMA, frame

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def by_hand(text, dimension):
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    total = np.zeros(dimension)
    for i in range(len(clean) - 2):
        a, b, c = (language_id.letter_vectors(np.array([ord(x)]), dimension)[0].astype(int) for x in clean[i : i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_bundles():
    texts = ["Hello, World", "é 中文 ok", "", None, "a"]
    found = language_id.bundles(texts, np.arange(5), 5, 128, 3)
    for text, row in zip(texts, found):
        assert np.array_equal(row, by_hand(text, 128) if text else np.zeros(128))
    grouped = language_id.bundles(texts, np.array([0, 1, 1, 0, 0]), 2, 128, 3)
    assert np.array_equal(grouped, [found[0] + found[3] + found[4], found[1] + found[2]])


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="supplied tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS)
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    own = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(own) / len(own) > 0.97


def test_awkward_rows(spark):
    learn = [(k, t, lang, "s", 0, "x", 1, None) for k in range(20) for t, lang in [("the cat and the hat", "en"), ("der hund und die katze", "de")]]
    more = [(100, None, "en"), (101, "", "en"), (102, "123 ...", None), (103, "and the", None), (None, "und die", "xx")]
    docs = spark.createDataFrame(learn + [(*r, "s", 0, "x", 1, None) for r in more], SCHEMA)
    found = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.identify(docs).collect()}
    assert found[100] == found[101] == found[102] == ("und", False)
    assert found[103] == ("en", True) and found[None] == ("de", True)
    nothing = spark.createDataFrame([(1, "text", None, "s", 0, "x", 1, None)], SCHEMA)
    assert language_id.identify(nothing).first()["lang_pred"] == "und"
    assert language_id.identify(frame(spark, [])).count() == 0
