"""Reads of the result table: rankings, lookups, buckets, mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_by(results: DataFrame, column: str, k: int, key: str = "repo_id") -> DataFrame:
    """The k rows with the greatest `column`, ties by key; keeps k rows per task."""
    return results.orderBy(F.col(column).desc(), F.col(key)).limit(k)


def with_status(results: DataFrame, *statuses: str) -> DataFrame:
    return results.filter(F.col("processing_status").isin(*statuses))


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """0 below the first edge, i from the i-th edge on; a value on an edge is above it."""
    number = F.lit(0)
    for i, edge in enumerate(edges, start=1):
        number = F.when(value >= edge, F.lit(i)).otherwise(number)
    return F.when(value.isNotNull(), number)


def quantile_buckets(df: DataFrame, column: str, buckets: int, accuracy: int = 10_000) -> DataFrame:
    """Add `bucket`: about equal shares of `column`, numbered from 0; NULL stays NULL.

    Edges come from a mergeable sketch in one pass; they are one row of `buckets` - 1 numbers,
    sent to the rows, which stay where they are. Equal edges count as one, so a very common value can
    leave buckets unused.
    """
    shares = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(column, shares, accuracy)
    edges = df.agg(F.array_distinct(F.coalesce(sketch, F.array().cast("array<double>"))).alias("edges"))
    joined = df.withColumn("sole", F.lit(1)).join(F.broadcast(edges.withColumn("sole", F.lit(1))), "sole", "left")
    number = F.size(F.filter("edges", lambda e: e <= F.col(column)))
    return joined.withColumn("bucket", F.when(F.col(column).isNotNull(), number)).drop("sole", "edges")


def sample_position(key: Column, seed: int) -> Column:
    """A stable position in [0, 10000) from the key alone, so that neither
    partitioning nor reruns change which rows are drawn."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.pmod(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint"), F.lit(10_000))


def mixture(
    df: DataFrame, key: str, bucket_column: str, rates: Mapping[object, float], seed: int = 0
) -> DataFrame:
    """Draw each bucket at its own rate; buckets without a rate are left out."""
    rate = F.lit(0.0)
    for value, share in rates.items():
        rate = F.when(F.col(bucket_column) == value, F.lit(float(share))).otherwise(rate)
    return df.filter(sample_position(F.col(key), seed) < rate * 10_000)


def token_cuts(
    df: DataFrame, key: str, bucket_column: str, tokens_column: str, weights: Mapping[object, int], seed: int = 0
) -> dict[object, int]:
    """Per bucket the last position drawn, so that the drawn tokens stand in the ratio of
    `weights` and are as many as the scarcest bucket allows.

    One aggregation gives the tokens of each bucket and position, 10,000 rows a bucket at
    most; their running sums give the cuts. Each bucket falls short of its part by less than
    the tokens of one position. Buckets that hold no tokens take no part.
    """
    rows = df.filter(F.col(bucket_column).isin(*weights)).select(
        F.col(bucket_column).alias("bucket"),
        sample_position(F.col(key), seed).alias("position"),
        F.coalesce(F.col(tokens_column), F.lit(0)).cast("bigint").alias("tokens"),
    )
    histogram = rows.groupBy("bucket", "position").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy("bucket").orderBy("position"))
    # At most 10,001 numbers per weight, whatever the number of rows.
    sums = histogram.select("bucket", "position", upto.alias("upto")).groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("position", "upto"))).alias("sums")
    )
    found = {r["bucket"]: r["sums"] for r in sums.collect()}
    totals = {b: own[-1]["upto"] for b, own in found.items() if own[-1]["upto"] > 0 and weights[b] > 0}
    if not totals:
        return {}
    # Whole numbers only, so that no rounding decides about a position.
    scarce = min(totals, key=lambda b: (Fraction(totals[b], weights[b]), str(b)))
    cuts = {}
    for b in totals:
        fit = [s["position"] for s in found[b] if s["upto"] * weights[scarce] <= totals[scarce] * weights[b]]
        if fit:
            cuts[b] = fit[-1]
    return cuts


def mixture_by_tokens(
    df: DataFrame, key: str, bucket_column: str, tokens_column: str, weights: Mapping[object, int], seed: int = 0
) -> DataFrame:
    """Draw rows so that the buckets' tokens stand in the ratio of `weights` (whole numbers).

    Reads `df` twice, once for `token_cuts`; the draw itself is a filter. Buckets without a
    weight are left out.
    """
    cuts = token_cuts(df, key, bucket_column, tokens_column, weights, seed)
    last = F.lit(-1)
    for value, cut in cuts.items():
        last = F.when(F.col(bucket_column) == value, F.lit(cut)).otherwise(last)
    return df.filter(sample_position(F.col(key), seed) <= last)
