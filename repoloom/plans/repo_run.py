"""One run over a repository list: gates, measurements, outcome rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.operators import files as files_ops
from repoloom.operators import outcomes, repos as repo_ops, score, totals
from repoloom.plans import graph_plan
from repoloom.settings import Settings
from repoloom.sources.staging import StagedTable, Staging
from repoloom.sources.tables import files_of, processed_keys


def stage_facts(
    files: DataFrame, candidates: StagedTable, settings: Settings, staging: Staging
) -> DataFrame:
    """Facts of candidates' files, written down: three later steps read them, and
    none of them should scan or parse content again."""
    chosen = files_of(files, candidates.df, settings.file_buckets)
    facts = files_ops.file_facts(chosen, settings).join(candidates.df, "repo_id", "left_semi")
    return staging.save(facts, "facts").df


def run(
    repos: DataFrame,
    metadata: DataFrame,
    snapshots: DataFrame,
    files: DataFrame,
    stored: DataFrame,
    staging: Staging,
    settings: Settings = Settings(),
    limit: int | None = None,
) -> DataFrame:
    """Outcome rows for repositories without a stored row.

    `metadata` is the raw harvest, `stored` any frame with the stored rows. The
    cheap gates come first; files are read once; only repositories with enough
    tokens get a graph.
    """
    todo = repo_ops.unprocessed(
        repo_ops.first_repos(repos, limit), processed_keys(stored, settings.retry_statuses)
    )
    gated = staging.save(
        outcomes.first_gates(
            repo_ops.with_names(todo), repo_ops.latest_metadata(metadata), snapshots, settings
        ),
        "gated",
    ).df
    candidates = staging.save(
        gated.filter(F.col("early_status").isNull()).select(F.col("id").alias("repo_id")),
        "candidates",
    )
    facts = stage_facts(files, candidates, settings, staging)
    counted = staging.save(totals.token_totals(facts), "totals").df
    enough = counted.filter(
        ~totals.too_few_tokens(
            F.col("total_tokens"), settings.min_tokens, F.col("counter"), settings.counter_name
        )
    ).select("repo_id")
    graphed = facts.join(enough, "repo_id", "left_semi")
    metrics = score.rounded(graph_plan.metrics_from_facts(graphed, settings, staging))
    failures = (
        facts.filter(F.col("failure").isNotNull())
        .groupBy("repo_id")
        .agg(F.min("failure").alias("failure"))
    )
    return outcomes.outcome_rows(gated, counted, metrics, failures, settings)
