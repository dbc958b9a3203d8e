"""Mixtures by tokens against their shares."""

import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from repoloom.operators import serving


def position(key, seed):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) % 10_000


def test_shares_hold(spark):
    # The first bucket has a third of all tokens in a few rows of one size, the last one many small rows.
    rows = spark.range(60_000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 10 < 2, "a").when(F.col("id") % 10 < 5, "b").otherwise("c").alias("bucket"),
        F.when(F.col("id") % 10 < 2, 300).otherwise(F.col("id") % 97).alias("tokens"),
    )
    weights = {"a": 2, "b": 5, "c": 3}
    drawn = serving.mixture_by_tokens(rows, "key", "bucket", "tokens", weights, seed=3)
    found = {r["bucket"]: r["n"] for r in drawn.groupBy("bucket").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(found.values())
    assert all(abs(found[b] / total - w / 10) < 0.01 for b, w in weights.items())
    # The scarcest bucket is used up.
    assert found["b"] == rows.filter("bucket = 'b'").agg(F.sum("tokens")).first()[0]


def test_cuts_match_a_plain_search(spark):
    rows = [(k, k % 3, (k * 7919) % 50) for k in range(400)] + [(500, None, 9), (501, 7, 9), (502, 1, None)]
    weights = {0: 1, 1: 4, 2: 2, 9: 5}
    df = spark.createDataFrame(rows, "key long, bucket int, tokens long").withColumn("position", F.lit("x"))
    listed = [r for r in rows if r[1] in weights]
    totals = {b: sum(t or 0 for _, x, t in listed if x == b) for b in (0, 1, 2)}
    budget = min(Fraction(totals[b], weights[b]) for b in totals)
    expected = []
    for b in totals:
        upto = 0
        places = sorted({position(k, 0) for k, x, _ in listed if x == b})
        for place in places:
            own = [(k, t or 0) for k, x, t in listed if x == b and position(k, 0) == place]
            upto += sum(t for _, t in own)
            if upto > budget * weights[b]:
                break
            expected += [k for k, _ in own]
    drawn = serving.mixture_by_tokens(df, "key", "bucket", "tokens", weights)
    assert drawn.columns == df.columns
    assert sorted(r["key"] for r in drawn.collect()) == sorted(expected)


def test_nothing_to_draw(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, None, 5)], "key long, bucket int, tokens long")
    assert serving.mixture_by_tokens(df, "key", "bucket", "tokens", {0: 1}).count() == 0
    assert serving.mixture_by_tokens(df.limit(0), "key", "bucket", "tokens", {0: 1}).count() == 0


def test_edges_do_not_move_rows(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    plan = serving.quantile_buckets(df, "v", 4)._jdf.queryExecution().executedPlan().toString()
    # The only exchange apart from the sketch's is the one row of edges.
    assert "BroadcastExchange" in plan and not any(x in plan for x in ("SortMergeJoin", "CartesianProduct", "hashpartitioning"))
