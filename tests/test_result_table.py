"""The stored result table: versions, repeated and concurrent runs, refusal, lookups."""

import datetime

import pytest
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.sources import results
from repoloom.sources.versions import VersionedTable

T1 = datetime.datetime(2024, 1, 1)


def rows(spark, *wanted, **more):
    """Completed rows (repository, score), with other columns as given."""
    values = {"string": "x", "bigint": 0, "double": 0.0}
    names = schemas.RESULT.fieldNames()
    made = []
    for repo, score in wanted:
        row = [None if f.nullable else values.get(f.dataType.simpleString()) for f in schemas.RESULT]
        given = {"repo_id": repo, "dependency_score": score, "processing_status": "completed", "processed_at": T1, **more}
        for name, value in given.items():
            row[names.index(name)] = value
        made.append(tuple(row))
    return spark.createDataFrame(made, results._nullable(schemas.RESULT))


def scores(spark, path, version=None):
    return {r["repo_id"]: r["dependency_score"] for r in results.read_results(spark, path, version).collect()}


def test_unnamed_runs_add_up_and_named_ones_replace_themselves(spark, staging):
    path = staging.path("results")
    assert scores(spark, path) == {}
    results.store(rows(spark, ("a", 0.1)), path)
    results.store(rows(spark, ("b", 0.2)), path)
    assert scores(spark, path) == {"a": 0.1, "b": 0.2}
    results.store(rows(spark, ("c", 0.3), ("d", 0.4)), path, "one/0")
    results.store(rows(spark, ("b", 0.5)), path, "two/0")
    results.store(rows(spark, ("c", 0.6)), path, "one/0")
    assert scores(spark, path) == {"a": 0.1, "b": 0.5, "c": 0.6}
    assert scores(spark, path, 3) == {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}
    with pytest.raises(ValueError):
        results.read_results(spark, path, 99)


def test_dirty_rows_leave_the_table_unchanged(spark, staging):
    path = staging.path("results")
    results.store(rows(spark, ("a", 0.1)), path)
    table = VersionedTable(spark, path)
    for dirty, rule in (
        (rows(spark, ("b", 0.2), ("b", 0.3), ("b", 0.4)), {"unique repo_id": 2}),
        (rows(spark, ("b", None)), {"not null dependency_score": 1}),
        (rows(spark, ("b", 0.2), url=None).union(rows(spark, ("c", 0.2))), {"not null url": 1}),
    ):
        with pytest.raises(results.ConstraintError) as refused:
            results.store(dirty, path)
        assert refused.value.violations == rule
    assert scores(spark, path) == {"a": 0.1} and table.versions() == [1]
    assert len(table._names("runs")) == 1


def test_a_failing_run_leaves_the_table_unchanged(spark, staging):
    path = staging.path("results")
    results.store(rows(spark, ("a", 0.1)), path, "day")
    broken = rows(spark, ("a", 0.9)).withColumn("dependency_score", F.raise_error(F.lit("lost half-way")).cast("double"))
    with pytest.raises(Exception, match="lost half-way"):
        results.store(broken, path, "day")
    assert scores(spark, path) == {"a": 0.1}
    results.store(rows(spark, ("a", 0.2)), path, "day")
    assert scores(spark, path) == {"a": 0.2}
    table = VersionedTable(spark, path)
    assert table.remove_unlisted()  # what the failed and the replaced run left
    assert scores(spark, path) == {"a": 0.2} and len(table._names("runs")) == 1


def test_two_writers_at_the_same_version(spark, staging):
    path = staging.path("results")
    table = VersionedTable(spark, path)
    results.store(rows(spark, ("a", 0.1)), path)
    seen = []

    def change(runs):
        # Another writer commits between our read and our rename, once.
        if not seen:
            results.store(rows(spark, ("b", 0.2)), path)
        seen.append(len(runs))
        return list(runs)

    assert table.commit(change).number == 3
    assert seen == [1, 2]
    assert scores(spark, path) == {"a": 0.1, "b": 0.2}


def test_compaction_keeps_rows_measurements_and_readers(spark, staging):
    path = staging.path("results")
    results.store(rows(spark, ("a", 0.1), ("b", 0.2), graph_density=0.5), path)
    results.store(rows(spark, ("a", 0.0), processing_status="error", error_message="later"), path)
    before = results.read_results(spark, path).orderBy("repo_id").collect()
    version = results.compact(spark, path)
    assert len(version.runs) == 1 and version.runs[0].merged
    assert results.read_results(spark, path).orderBy("repo_id").collect() == before
    assert before[0]["graph_density"] == 0.5 and before[0]["error_message"] == "later"
    results.store(rows(spark, ("c", 0.3)), path)
    results.store(rows(spark, ("a", 0.7), graph_density=0.25), path)
    found = {r["repo_id"]: (r["dependency_score"], r["graph_density"], r["error_message"]) for r in results.read_results(spark, path).collect()}
    assert found == {"a": (0.7, 0.25, "later"), "b": (0.2, 0.5, None), "c": (0.3, None, None)}
    assert scores(spark, path, 2) == {"a": 0.0, "b": 0.2}
    assert scores(spark, staging.path("none")) == {}
    assert results.compact(spark, staging.path("none")).number == 0


@pytest.mark.parametrize("compacted", [False, True])
def test_lookups_equal_the_merged_table(spark, staging, compacted):
    path = staging.path("results")
    results.store(rows(spark, *((f"r{k:03d}", k / 200) for k in range(200))), path)
    results.store(rows(spark, *((f"r{k:03d}", 0.0) for k in range(0, 200, 7)), processing_status="skipped"), path)
    if compacted:
        results.compact(spark, path)
        results.store(rows(spark, ("r199", 0.01), ("new", 0.98)), path)
        results.store(rows(spark, ("r010", 0.0), processing_status="error"), path)
    merged = results.read_results(spark, path)
    for statuses in (("skipped",), ("error", "skipped"), ("completed",), ("unknown",)):
        wanted = merged.filter(F.col("processing_status").isin(*statuses)).select("repo_id", "processing_status")
        found = results.lookup(spark, path, *statuses).select("repo_id", "processing_status")
        assert sorted(found.collect()) == sorted(wanted.collect())
    for k in (1, 5, 60, 500):
        wanted = merged.orderBy(F.desc("dependency_score"), "repo_id").limit(k).select("repo_id", "dependency_score").collect()
        assert results.top_scores(spark, path, k).select("repo_id", "dependency_score").collect() == wanted


def test_lookups_read_only_their_partitions(spark, staging):
    path = staging.path("results")
    results.store(rows(spark, *((f"r{k:03d}", k / 100) for k in range(100))), path)
    results.compact(spark, path)

    def partition_filters(frame):
        spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]

    assert "processing_status" in partition_filters(results.lookup(spark, path, "completed"))
    assert "band" in partition_filters(results.top_scores(spark, path, 5))
    assert ">= 9" in partition_filters(results.top_scores(spark, path, 5))
