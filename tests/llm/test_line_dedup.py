"""Edit join against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from repoloom.llm import line_dedup
from samples import frame


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, times):
    chars = list(text)
    for _ in range(times):
        at = rng.randrange(len(chars) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars.insert(at, rng.choice("abñ"))
        elif chars and kind == 1:
            chars.pop(min(at, len(chars) - 1))
        elif chars:
            chars[min(at, len(chars) - 1)] = rng.choice("abñ")
    return "".join(chars)


def brute(rows, k, min_chars):
    seen, result = [], []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, text in order:
        every = text.split("\n") if text else []
        kept = []
        for line in every:
            own = line.strip(" ")
            if len(own) < min_chars or not any(abs(len(own) - len(o)) <= k and levenshtein(own, o) <= k for o in seen):
                kept.append(line)
            if len(own) >= min_chars:
                seen.append(own)
        result.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return result


def documents(rng):
    base = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randrange(18, 60))) for _ in range(50)]
    rows = [(k, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(6)))) for k in range(70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [1, 2, 3])
def test_distance(spark, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abñ ") for _ in range(rng.randrange(40)))
        pairs.append((a, changed(rng, a, rng.randrange(5))))
    rows = spark.createDataFrame(pairs, "x string, y string")
    found = rows.select((line_dedup.edit_distance(F.col("x"), F.col("y"), k) <= k).alias("f"), (F.levenshtein("x", "y") <= k).alias("w"))
    assert all(r["f"] == r["w"] for r in found.collect())


@pytest.mark.parametrize("k", [1, 2])
def test_lines_match_all_pairs(spark, k):
    rows = documents(random.Random(10 + k)) + [(200, None), (201, ""), (202, "\n\n")]
    found = line_dedup.deduplicate(frame(spark, rows), k).collect()
    assert sorted(map(tuple, found)) == brute(rows, k, line_dedup.MIN_CHARS)


def test_plan_has_no_python(spark):
    plan = line_dedup.deduplicate(frame(spark, [(1, "x" * 30)]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_stage_keeps_columns(spark):
    line = "the very same line in every text"
    docs = frame(spark, [(1, f"{line}\nown words here"), (2, f"{line}\nother"), (3, line), (None, line), (4, None), (5, "")])
    kept = line_dedup.keep_lines(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in kept.collect())
    assert found == [("1", f"{line}\nown words here", 47), ("2", "other", 5), ("4", None, None), ("5", "", 0), ("None", line, 32)]
    assert line_dedup.keep_lines(frame(spark, [])).count() == line_dedup.deduplicate(frame(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    x, y, z = (c * 30 for c in "xyz")
    rows = [(1, f"{x}\n{y}"), (2, f"{z}\n{x}"), (2, f"own\nshort\n{y}"), (2, None), (3, z), (4, f"{z}x\nend"), (4, f"{z}x\nend")]
    expected = [(1, f"{x}\n{y}"), (2, z), (2, "own\nshort"), (2, ""), (3, ""), (4, "end"), (4, "end")]
    docs = frame(spark, rows).withColumn("key", F.lit(0)).withColumn("gone_key", F.lit("k"))
    found = line_dedup.deduplicate(docs).select("doc_id", "kept_text").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    kept = line_dedup.keep_lines(docs)
    assert kept.columns == docs.columns
    texts = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted((i, t) for i, t in expected if (i, t) != (3, ""))
