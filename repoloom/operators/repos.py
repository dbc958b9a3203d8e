"""Repository list: names, metadata, resume and the size gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.settings import HOST_PREFIX


def first_repos(repos: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` repositories by id; 0 or None keeps all."""
    return repos.orderBy("id").limit(limit) if limit else repos


def unprocessed(repos: DataFrame, processed: DataFrame) -> DataFrame:
    """Repositories without a stored row (`processed` holds `repo_id`)."""
    return repos.join(processed, repos["id"] == processed["repo_id"], "left_anti")


def once(repos: DataFrame) -> DataFrame:
    """One row per repository; which of its rows is taken does not depend on their order."""
    others = [c for c in repos.columns if c != "id"]
    rows = repos.groupBy("id").agg(F.max(F.struct(*others)).alias("row"))
    return rows.select("id", "row.*").select(*repos.columns)


def full_name(name: Column, url: Column) -> Column:
    """The stored name, else the URL without its host prefix; NULL if neither helps."""
    from_url = F.replace(url, F.lit(HOST_PREFIX), F.lit(""))
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(from_url, F.lit("")))


def with_names(repos: DataFrame) -> DataFrame:
    """Settle `full_name` and `url`; rows without a name are dropped."""
    named = repos.withColumn("full_name", full_name(F.col("full_name"), F.col("url")))
    return named.filter(F.col("full_name").isNotNull()).withColumn(
        "url", F.coalesce("url", F.concat(F.lit(HOST_PREFIX), "full_name"))
    )


def latest_metadata(harvest: DataFrame) -> DataFrame:
    """The newest successful lookup per name, with defaults filled in."""
    fields = ("size_kb", "language", "default_branch")
    return (
        harvest.filter(F.col("http_status").between(200, 299))
        .groupBy("full_name")
        .agg(F.max(F.struct("fetched_at", *fields)).alias("latest"))
        .select(
            "full_name",
            F.coalesce("latest.size_kb", F.lit(0)).cast("bigint").alias("size_kb"),
            F.col("latest.language").alias("language"),
            F.coalesce("latest.default_branch", F.lit("main")).alias("default_branch"),
        )
    )


def with_metadata(named: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join by name; `has_metadata` tells a miss from NULL fields."""
    found = metadata.withColumn("has_metadata", F.lit(True))
    return named.join(found, "full_name", "left").withColumn(
        "has_metadata", F.coalesce("has_metadata", F.lit(False))
    )


def too_small(size_kb: Column, minimum: int) -> Column:
    return size_kb < minimum
