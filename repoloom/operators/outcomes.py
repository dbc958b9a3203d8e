"""Exactly one outcome row per named repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.operators import repos as R
from repoloom.operators.totals import too_few_tokens
from repoloom.settings import (
    ERROR_TEXT_LIMIT,
    NO_SNAPSHOT_TEXT,
    STATUS_COMPLETED,
    STATUS_ERROR,
    STATUS_NO_METADATA,
    STATUS_NO_SNAPSHOT,
    STATUS_SKIPPED,
    Settings,
)


# Fixed value: start of the message of a repository that failed the size gate.
SIZE_TEXT = "size_kb="


def first_gates(
    named: DataFrame, metadata: DataFrame, snapshots: DataFrame, settings: Settings
) -> DataFrame:
    """Join metadata and snapshots and decide what can be decided without files.

    `early_status` is NULL for candidates, whose files are worth reading. Gates
    mark rows instead of dropping them, since every repository gets an outcome. A
    repository with several snapshots counts as taken if one of them succeeded; one
    that is listed several times gets one row (see `R.once`).
    """
    taken = snapshots.groupBy(F.col("repo_id").alias("id")).agg(F.max("ok").alias("ok"))
    marked = R.with_metadata(R.once(named), metadata).join(taken, "id", "left")
    status = (
        F.when(~F.col("has_metadata"), F.lit(STATUS_NO_METADATA))
        .when(R.too_small(F.col("size_kb"), settings.min_size_kb), F.lit(STATUS_SKIPPED))
        .when(~F.coalesce("ok", F.lit(False)), F.lit(STATUS_NO_SNAPSHOT))
    )
    return marked.withColumn("early_status", status)


def outcome_rows(
    gated: DataFrame,
    totals: DataFrame,
    metrics: DataFrame,
    failures: DataFrame,
    settings: Settings,
) -> DataFrame:
    """Result rows from gated repositories and whatever was measured for them.

    One ladder of conditions over left joins. A row that is not completed stores
    zeros and NULLs, whatever had been measured before it failed.
    """
    joined = (
        gated.withColumnRenamed("id", "repo_id")
        .join(totals, "repo_id", "left")
        .join(metrics, "repo_id", "left")
        .join(failures, "repo_id", "left")
    )
    few = too_few_tokens(
        F.col("total_tokens"), settings.min_tokens, F.col("counter"), settings.counter_name
    )
    status = (
        F.when(F.col("early_status").isNotNull(), F.col("early_status"))
        .when(few, F.lit(STATUS_SKIPPED))
        .when(F.col("failure").isNotNull(), F.lit(STATUS_ERROR))
        .otherwise(F.lit(STATUS_COMPLETED))
    )
    size_text = F.format_string(f"{SIZE_TEXT}%d < {settings.min_size_kb}", "size_kb")
    token_text = F.format_string(
        f"tokens=%d < {settings.min_tokens}", F.coalesce("total_tokens", F.lit(0))
    )
    early = F.col("early_status")
    message = (
        F.when(early == STATUS_SKIPPED, size_text)
        .when(early == STATUS_NO_SNAPSHOT, F.lit(NO_SNAPSHOT_TEXT))
        .when(F.col("processing_status") == STATUS_SKIPPED, token_text)
        .when(
            F.col("processing_status") == STATUS_ERROR,
            F.substring("failure", 1, ERROR_TEXT_LIMIT),
        )
    )
    done = F.col("processing_status") == STATUS_COMPLETED

    def measured(column: str, zero=None):
        return F.when(done, F.coalesce(F.col(column), F.lit(zero))).otherwise(F.lit(zero))

    rows = joined.withColumn("processing_status", status).select(
        F.left(F.sha2("repo_id", 256), F.lit(32)).alias("id"),
        "repo_id",
        "full_name",
        "url",
        F.coalesce("size_kb", F.lit(0)).alias("github_size_kb"),
        F.col("language").alias("primary_language"),
        "default_branch",
        measured("total_tokens", 0).alias("total_code_tokens"),
        measured("total_files", 0).alias("total_code_files"),
        measured("total_bytes", 0).alias("total_code_bytes"),
        measured("tokens_by_extension").alias("tokens_by_extension"),
        measured("counter").alias("token_counter"),
        measured("dependency_score", 0.0).alias("dependency_score"),
        measured("internal_import_count", 0).alias("internal_import_count"),
        measured("unique_internal_imports", 0).alias("unique_internal_imports"),
        measured("graph_density").alias("graph_density"),
        measured("avg_in_degree").alias("avg_in_degree"),
        # A repository without any graph node still stores counts of 0.
        F.when(done, F.coalesce("max_in_degree", F.lit(0))).alias("max_in_degree"),
        F.when(done, F.coalesce("num_connected_components", F.lit(0))).alias(
            "num_connected_components"
        ),
        measured("largest_component_fraction").alias("largest_component_fraction"),
        "conference",
        "year",
        "paper_title",
        "processing_status",
        message.alias("error_message"),
        F.current_timestamp().alias("processed_at"),
    )
    return schemas.conform(rows, schemas.RESULT)


def status_counts(results: DataFrame) -> DataFrame:
    """Run summary: repositories per outcome."""
    return results.groupBy("processing_status").agg(F.count(F.lit(1)).alias("repos"))


def progress_counts(repos: DataFrame, stored: DataFrame, results: DataFrame) -> DataFrame:
    """(measure, repos) of one run, a row each:

    already_done: repositories with a stored row; to_process: listed ones without;
    candidates: those that passed the metadata and size gates; filtered: the rest
    of to_process; passed: completed ones.
    """
    done = stored.select("repo_id").distinct()
    too_early = (F.col("processing_status") == STATUS_NO_METADATA) | F.coalesce(
        F.col("error_message").startswith(SIZE_TEXT), F.lit(False)
    )
    candidate = (~too_early).cast("bigint")
    completed = (F.col("processing_status") == STATUS_COMPLETED).cast("bigint")

    def marks(df: DataFrame, **values) -> DataFrame:
        pairs = [F.struct(F.lit(k).alias("measure"), v.alias("n")) for k, v in values.items()]
        return df.select(F.inline(F.array(*pairs)))

    one = F.lit(1).cast("bigint")
    counted = (
        marks(done, already_done=one)
        .unionByName(marks(R.unprocessed(repos, done), to_process=one, filtered=one))
        .unionByName(marks(results, candidates=candidate, filtered=-candidate, passed=completed))
    )
    return counted.groupBy("measure").agg(F.sum("n").alias("repos"))
