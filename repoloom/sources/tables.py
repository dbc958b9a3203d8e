"""Input tables: repositories, metadata, snapshots, packed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.operators.prefilter import likely_in


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.REPOS)


def read_repos_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Repository list from a database, read in parallel ranges instead of pages."""
    rows = spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
    return schemas.conform(rows, schemas.REPOS)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.METADATA)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.SNAPSHOTS)


BUCKET = "repo_bucket"


def repo_bucket(repo_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(repo_id), F.lit(buckets)).cast("int")


def pack_files(files: DataFrame, path: str, buckets: int) -> None:
    """Write the packed file table in folders by repository bucket.

    A later run over few repositories then opens only their folders. The one
    shuffle of content happens here, when files are taken in. The planner splits
    it by measured size (`spark.sql.adaptive.advisoryPartitionSizeInBytes`), so a
    repository with a large share of all files is written by many tasks; within
    a task rows are sorted, which lets Parquet statistics skip row groups of other
    repositories.
    """
    (
        schemas.conform(files, schemas.FILES)
        .withColumn(BUCKET, repo_bucket(F.col("repo_id"), buckets))
        .hint("rebalance", F.col(BUCKET))
        .sortWithinPartitions(BUCKET, "repo_id")
        .write.mode("append")
        .partitionBy(BUCKET)
        .parquet(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Packed file table, one row per file; `content` is read only where used.

    The bucket column of `pack_files` is kept where there is one.
    """
    rows = spark.read.parquet(path)
    files = schemas.conform(rows, schemas.FILES)
    return rows.select(*files.columns, BUCKET) if BUCKET in rows.columns else files


def files_of(files: DataFrame, repos: DataFrame, buckets: int | None = None) -> DataFrame:
    """Files of the given repositories and few others, without shuffling file content.

    Content of the others is not decoded, whatever the number of `repos` (repo_id): a
    filter of fixed size stands in front. The caller semi-joins the compact facts. With
    the number of `buckets` that the table was packed in, folders without any of the
    repositories are not even opened; their numbers, no more than `buckets` integers,
    become a partition filter.
    """
    if buckets and BUCKET in files.columns:
        numbers = repos.select(repo_bucket(F.col("repo_id"), buckets).alias("b")).distinct()
        files = files.filter(F.col(BUCKET).isin([r["b"] for r in numbers.collect()]))
    return likely_in(files, repos, ["repo_id"]).drop(BUCKET)


def processed_keys(results: DataFrame, retry_statuses: tuple[str, ...] = ()) -> DataFrame:
    """Repositories that a stored row marks as done; failures count unless retried."""
    rows = results
    if retry_statuses:
        rows = rows.filter(~F.col("processing_status").isin(*retry_statuses))
    return rows.select("repo_id").distinct()
