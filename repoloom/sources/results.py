"""Result rows: merge by repository, a versioned table of runs, contract checks.

Each run is stored in a folder of its own, split by status and by score band and sorted by
score within, and counted while it is written. It becomes part of the table only if its rows
keep the contract. Reads merge runs by repository; a compacted table holds each repository
once, so lookups read only the partitions they ask for.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom import schemas
from repoloom.settings import STATUS_COMPLETED
from repoloom.sources.staging import delete_path
from repoloom.sources.versions import Run, Version, VersionedTable

# Columns a failure row does not supply: an older value stays in place.
MEASURED_ONLY = (
    "tokens_by_extension",
    "token_counter",
    "graph_density",
    "avg_in_degree",
    "max_in_degree",
    "num_connected_components",
    "largest_component_fraction",
)
# Set when a repository is first stored and kept ever after.
FIRST_INSERT = ("id", "processed_at")


def merge_results(rows: DataFrame, order: Sequence[str] = ("batch_id",), merged: str | None = None) -> DataFrame:
    """One row per repository: for each column, the latest value supplied for it.

    A failure row supplies no measurements and a completed row no error text, so
    those keep what an earlier row stored. Rows flagged by `merged` are the result of an
    earlier merge and supply every column. One partially aggregated grouping, without a
    join. (Strings and maps in its state make it a sorting one.)
    """
    order = F.struct(*order)
    whole = F.col(merged) if merged else F.lit(False)
    completed = F.col("processing_status") == STATUS_COMPLETED
    picked = []
    for field in schemas.RESULT:
        name = field.name
        if name == "repo_id":
            continue
        # A struct keeps "supplied as NULL" apart from "not supplied".
        boxed = F.struct(F.col(name).alias("v"))
        if name in FIRST_INSERT:
            chosen = F.min_by(boxed, order)
        elif name in MEASURED_ONLY:
            chosen = F.max_by(boxed, F.when(completed | whole, order))
        elif name == "error_message":
            chosen = F.max_by(boxed, F.when(~completed | whole, order))
        else:
            chosen = F.max_by(boxed, order)
        picked.append(chosen.getField("v").alias(name))
    return rows.groupBy("repo_id").agg(*picked).select(*schemas.RESULT.fieldNames())


def upsert(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """`existing` with `updates` applied by repository, as a new frame.

    Within `updates` the latest `processed_at` wins, whole rows breaking ties.
    """
    columns = schemas.RESULT.fieldNames()
    # Maps cannot be compared, so ties are broken on the other columns.
    sortable = [c for c in columns if c not in ("processed_at", "tokens_by_extension")]
    rank = F.struct("processed_at", *sortable)
    latest = (
        updates.select(*columns)
        .groupBy("repo_id")
        .agg(F.max_by(F.struct(*columns), rank).alias("row"))
        .select("row.*")
    )
    both = existing.select(*columns, F.lit(0).alias("batch_id")).unionByName(
        latest.withColumn("batch_id", F.lit(1))
    )
    return merge_results(both)


# --- The stored table -----------------------------------------------------------------

STORED_ORDER = ("stored_at", "run")
BANDS = 10
PARTITIONS = ("processing_status", "band")
STORED = T.StructType(
    [*schemas.RESULT.fields]
    + [T.StructField("stored_at", T.LongType()), T.StructField("run", T.StringType())]
    + [T.StructField("merged", T.BooleanType()), T.StructField("folder", T.StringType()), T.StructField("band", T.IntegerType())]
)
REQUIRED = [f.name for f in schemas.RESULT if not f.nullable]


class ConstraintError(ValueError):
    """Rows that break the result contract; nothing was stored. `violations`: rows per rule."""

    def __init__(self, violations: dict[str, int]):
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in sorted(violations.items())))
        self.violations = violations


def score_band(score: Column) -> Column:
    """0 to BANDS - 1, rising with a score between 0 and 1."""
    return F.coalesce(F.least(F.greatest(F.floor(score * BANDS), F.lit(0)), F.lit(BANDS - 1)), F.lit(0)).cast("int")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def _counts(rows: DataFrame) -> dict[str, int]:
    """Rows, rows per band, and per rule of the contract the rows that break it, in one
    grouping by repository with partial sums."""
    nulls = {f"not null {name}": F.count_if(F.col(name).isNull()) for name in REQUIRED}
    bands = {f"band {b}": F.count_if(F.col("band") == b) for b in range(BANDS)}
    columns = nulls | bands
    per_repo = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in columns.items()))
    totals = per_repo.agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("rows") - 1).alias("unique repo_id"),
        *(F.sum(F.col(f"`{name}`")).alias(name) for name in columns),
    ).first()
    return {name: value or 0 for name, value in totals.asDict().items()}


def _write(rows: DataFrame, table: VersionedTable, run: str, stored_at: int, merged: bool) -> Run:
    """Write rows of the result layout into a folder that no version lists yet, and count
    what was written; rows that break the contract delete the folder and raise."""
    folder = table.new_folder()
    stored = Run(run, folder, stored_at, 0, merged)
    extra = {"stored_at": F.lit(stored_at), "run": F.lit(run), "merged": F.lit(merged), "band": score_band(F.col("dependency_score"))}
    (
        rows.withColumns(extra)
        .hint("rebalance", *PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, F.desc("dependency_score"), "repo_id")
        .write.partitionBy(*PARTITIONS)
        .parquet(table.folder(stored))
    )
    counts = _counts(table.read(STORED, [stored]))
    broken = {rule: n for rule, n in counts.items() if n and rule.startswith(("not null ", "unique "))}
    if broken:
        delete_path(table.spark, table.folder(stored))
        raise ConstraintError(broken)
    return Run(run, folder, stored_at, counts["rows"], merged, tuple(counts[f"band {b}"] for b in range(BANDS)))


def store(results: DataFrame, path: str, run: str | None = None) -> Version:
    """Add one run's rows to the table at `path`; returns the new version.

    Without a `run` the library gives it an id of its own, so no other run is touched. A
    caller that may repeat a run after a failure names it: the later rows then replace those
    that the same run stored before, and only those. Rows that break the contract raise
    ConstraintError and leave the table as it is.
    """
    table = VersionedTable(results.sparkSession, path)
    written = _write(
        results.select(*schemas.RESULT.fieldNames()), table, run or uuid.uuid4().hex, time.time_ns(), merged=False
    )
    return table.commit(lambda runs: [*(r for r in runs if r.id != written.id), written])


def _rows_of(table: VersionedTable, runs: Sequence[Run]) -> DataFrame:
    some = [r for r in runs if r.rows]
    return table.read(STORED, some) if some else table.spark.createDataFrame([], _nullable(STORED))


def stored_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of all runs of a version (the latest by default); empty if there is none."""
    table = VersionedTable(spark, path)
    return _rows_of(table, table.version(version).runs)


def merged_rows(stored: DataFrame) -> DataFrame:
    """The result table that stored rows add up to."""
    return merge_results(stored, STORED_ORDER, "merged")


def read_results(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The result table as of a version, the latest by default."""
    return merged_rows(stored_rows(spark, path, version))


def compact(spark: SparkSession, path: str) -> Version:
    """Replace the runs of the latest version by one merged table. Readers of older versions
    keep theirs; runs stored meanwhile stay beside it."""
    table = VersionedTable(spark, path)
    done = table.version().runs
    if not done:
        return table.version()
    base = _write(merged_rows(_rows_of(table, done)), table, f"merged-{uuid.uuid4().hex}", max(r.stored_at for r in done), True)
    gone = {r.folder for r in done}
    return table.commit(lambda runs: [base, *(r for r in runs if r.folder not in gone)])


def _current(table: VersionedTable, version: Version, wanted: Column) -> DataFrame:
    """Rows of the merged table that `wanted` (over partition columns) lets through.

    Repositories that only the merged base knows come from its wanted partitions alone; the
    few that later runs touch are merged in full first.
    """
    columns = schemas.RESULT.fieldNames()
    base, later = ([r for r in version.runs if r.merged == flag] for flag in (True, False))
    settled = _rows_of(table, base)
    if not later:
        return settled.filter(wanted).select(*columns)
    changed = _rows_of(table, later)
    keys = changed.select("repo_id").distinct()
    untouched = settled.filter(wanted).join(keys, "repo_id", "left_anti").select(*columns)
    touched = merged_rows(changed.unionByName(settled.join(keys, "repo_id", "left_semi")))
    touched = touched.withColumn("band", score_band(F.col("dependency_score"))).filter(wanted)
    return untouched.unionByName(touched.select(*columns))


def lookup(spark: SparkSession, path: str, *statuses: str, version: int | None = None) -> DataFrame:
    """Result rows with one of these statuses."""
    table = VersionedTable(spark, path)
    return _current(table, table.version(version), F.col("processing_status").isin(*statuses))


def top_scores(spark: SparkSession, path: str, k: int, version: int | None = None) -> DataFrame:
    """The k rows of the highest score, ties by repository. The counts of each run say which
    score bands can hold them, and no others are read."""
    table = VersionedTable(spark, path)
    held = table.version(version)
    later = sum(r.rows for r in held.runs if not r.merged)
    above, lowest = 0, BANDS
    # Later runs may have taken away as many rows as they have.
    while lowest and above < k + later:
        lowest -= 1
        above += sum(r.bands[lowest] for r in held.runs if r.merged)
    rows = _current(table, held, F.col("band") >= lowest)
    return rows.orderBy(F.desc("dependency_score"), "repo_id").limit(k)


def constraint_violations(results: DataFrame) -> DataFrame:
    """Per rule of the result contract, how many rows break it (all 0 if sound)."""
    per_repo = results.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"null_{c}") for c in REQUIRED],
    )
    totals = per_repo.agg(
        F.sum(F.col("copies") - 1).alias("unique repo_id"),
        *[F.sum(f"null_{c}").alias(f"not null {c}") for c in REQUIRED],
    )
    return totals.unpivot([], totals.columns, "rule", "violations").select(
        "rule", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )
