"""Automaton scan against a search of all windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from repoloom.llm import decontaminate
from samples import frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, items, width=10):
    result = []
    for doc_id, text in rows:
        own, hit, names = words(text), set(), set()
        for item_id, item in items:
            tokens = words(item)
            size = min(width, len(tokens))
            for k in range(len(tokens) - size + 1 if tokens else 0):
                for i in range(len(own) - size + 1):
                    if own[i : i + size] == tokens[k : k + size]:
                        hit |= set(range(i, i + size))
                        names.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        result.append((str(doc_id), len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(result)


def case():
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([0, 1, 4, 10, 25]))) for k in range(30)] + [(30, None), (31, "É, né!"), (7, prose(rng, 12))]
    rows = []
    for k in range(60):
        text = prose(rng, 60)
        if k % 3 == 0:
            text = f"{text} {rng.choice(items)[1] or ''}".upper().replace(" ", rng.choice([" ", ", ", "\n--"]))
        rows.append((k, text))
    return rows + [(None, "É né"), (61, None), (62, ""), (62, "é-NÉ"), (63, items[4][1])], items


def digest(frame):
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in frame.collect())


def test_hits_match_all_windows(spark):
    rows, items = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judge(frame(spark, rows), benchmark)
    assert digest(found) == brute(rows, items)
    for r in found.collect():
        text = dict((str(i), t) for i, t in rows if i != 62).get(str(r["doc_id"]))
        if text:
            parts = [text.encode()[s["start"] : s["end"]].decode() for s in r["hit_spans"]]
            assert sum(len(words(p)) for p in parts) == r["n_hit"]


@pytest.mark.parametrize("block_bytes", [60, 300])
def test_blocks_give_the_same(spark, block_bytes):
    rows, items = case()
    rows += [(None, None), (None, rows[0][1]), (63, rows[3][1]), (63, rows[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judge(frame(spark, rows), benchmark, block_bytes=block_bytes)
    assert digest(found) == brute(rows, items)


@pytest.mark.parametrize("block_bytes", [4, 8 << 20])
def test_rows_are_kept_by_their_text(spark, block_bytes):
    benchmark = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "d")], "item_id long, text string")
    rows = [(None, "x a b"), (None, "x"), (None, None), (7, "c"), (7, "d"), (8, ""), (9, "A, B"), (9, "b a")]
    docs = frame(spark, rows).withColumn("bad_digest", F.lit(1)).withColumn("digest", F.lit("d"))
    kept = decontaminate.keep_clean(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    clean = [(None, "x"), (None, None), (7, "d"), (8, ""), (9, "b a")]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, frame(spark, clean).select("doc_id", "text").collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(frame(spark, []), none).count() == 0
    assert decontaminate.judge(frame(spark, [(1, "a b")]), none).first()["contaminated"] is False
    docs = frame(spark, [(1, "a b"), (2, "c")])
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, "c")], none.schema))
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == docs.columns
