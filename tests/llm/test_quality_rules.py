"""Measures against plain counting; cutoffs on planted junk."""

import random
import re
from collections import Counter

from repoloom.llm import quality_rules
from samples import SCHEMA, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    own = WORD.findall(text or "")
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    hit = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n#|\t") for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = list(enumerate([None, "", "a\n\na\n\n", "x x x x", " \n \n", *texts]))
    found = {r[0]: tuple(r)[1:6] for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert found == {i: brute(t) for i, t in rows}


def test_cutoffs_follow_the_group(spark):
    rng = random.Random(9)
    rows = []
    for k in range(200):
        lang, source = ("en", "a") if k % 2 else (None, "b")
        text = prose(rng, 80, 5000)
        if lang is None:  # a source in which symbols are usual
            text = text.replace(" ", " | ")
        rows.append((k, text, lang, source, 0, "x", 1, None))
    junk = prose(rng, 80, 5000).replace(" ", " | ")
    rows += [(500, junk, "en", "a", 0, "x", 1, None), (501, "too short", "en", "a", 0, "x", 1, None), (502, "a b c " * 40, "en", "a", 0, "x", 1, None), (503, junk, None, "b", 0, "x", 1, None)]
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[500] == (False, False) and found[503] == (False, True)
    assert found[501] == found[502] == (True, False)
    assert all(found[k][1] for k in range(200))


def test_sketches_merge_and_bound_the_error(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000, 7).select("id", quality_rules.bin_of(F.col("id")).alias("bin")).collect()
    assert all(r["bin"] <= r["id"] <= r["bin"] * (1 + 1 / 32) for r in rows)


def test_empty_table(spark):
    assert quality_rules.judge(frame(spark, [])).count() == 0
