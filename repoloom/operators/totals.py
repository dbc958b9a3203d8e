"""Token totals per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extension_totals(facts: DataFrame) -> DataFrame:
    """(repo_id, counter, extension, tokens, files, bytes) over counted, readable files."""
    return (
        facts.filter(F.col("counted") & F.col("readable"))
        .groupBy("repo_id", "counter", "extension")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("files"),
            F.sum("size_bytes").alias("bytes"),
        )
    )


def token_totals(facts: DataFrame) -> DataFrame:
    """Totals and the per-extension map, a row per repository and token counter: counts
    of different counters are never added up.

    Files collapse to a row per extension before they meet, so the map is built
    from no more entries than there are counted extensions.
    """
    return (
        extension_totals(facts)
        .groupBy("repo_id", "counter")
        .agg(
            F.sum("tokens").alias("total_tokens"),
            F.sum("files").alias("total_files"),
            F.sum("bytes").alias("total_bytes"),
            F.map_from_entries(F.collect_list(F.struct("extension", "tokens"))).alias(
                "tokens_by_extension"
            ),
        )
    )


def too_few_tokens(tokens: Column, minimum: int, counter: Column, expected: str) -> Column:
    """Is a total below the minimum? The minimum is meant for one token counter, so totals
    of another one are refused; a repository without counted files has no counter."""
    other = F.raise_error(F.format_string("tokens of counter %s at a gate for %s", counter, F.lit(expected)))
    counted = F.when(counter.isNull() | (counter == expected), F.coalesce(tokens, F.lit(0))).otherwise(other.cast("bigint"))
    return counted < minimum
