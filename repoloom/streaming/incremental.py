"""Runs over newly arrived repository lists, each stored exactly once."""

from __future__ import annotations

from concurrent.futures import Future
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.plans import repo_run
from repoloom.settings import Settings
from repoloom.sources import results
from repoloom.sources.staging import Staging


@dataclass
class Inputs:
    """The tables a run joins its repositories with."""

    metadata: DataFrame
    snapshots: DataFrame
    files: DataFrame


def run_and_store(
    spark: SparkSession,
    repos: DataFrame,
    inputs: Inputs,
    path: str,
    settings: Settings = Settings(),
    limit: int | None = None,
    run: str | None = None,
) -> None:
    """One run: unseen repositories in, their outcome rows stored at `path`.

    Rows that a run of the same name stored before do not count as seen, and storing
    replaces them, so a named run that is repeated after a failure ends the same. Rows of
    other runs stay as they are; a run without a name is never repeated.
    """
    staging = Staging(spark)
    try:
        earlier = results.stored_rows(spark, path)
        if run:
            earlier = earlier.filter(F.col("run") != run)
        rows = repo_run.run(
            repos, inputs.metadata, inputs.snapshots, inputs.files, results.merged_rows(earlier), staging, settings, limit
        )
        results.store(rows, path, run)
    finally:
        staging.close()


def run_stream(
    spark: SparkSession,
    arrivals: str,
    inputs: Inputs,
    path: str,
    checkpoint: str,
    settings: Settings = Settings(),
    files_per_batch: int = 1000,
):
    """Take up all repository lists that arrived as Parquet files, then stop.

    Returns the finished query. Spark's checkpoint remembers which files are
    done; runs named by query and batch make a repeated micro-batch harmless. A new
    checkpoint numbers its batches from 0 again, but has a new query id, so it adds to
    the results of others.
    """
    started: Future[str] = Future()

    def take(batch: DataFrame, batch_id: int) -> None:
        run_and_store(batch.sparkSession, batch, inputs, path, settings, run=f"{started.result()}/{batch_id}")

    query = (
        spark.readStream.schema(schemas.REPOS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(arrivals)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.set_result(str(query.id))
    query.awaitTermination()
    return query
