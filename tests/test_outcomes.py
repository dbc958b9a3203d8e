"""Gates, outcome rows, merging and incremental runs."""

import datetime as dt
import re

import pytest
from helpers import files
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.operators import outcomes, repos as repo_ops
from repoloom.plans import repo_run
from repoloom.settings import Settings
from repoloom.sources import results, tables
from repoloom.streaming import incremental

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
SMALL = Settings(min_tokens=10)


def repo_table(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (6 - len(r)) for r in rows], schemas.REPOS)


def meta_table(spark, rows):
    return spark.createDataFrame(rows, schemas.METADATA)


def snap_table(spark, rows):
    return spark.createDataFrame(rows, schemas.SNAPSHOTS)


def empty_results(spark):
    return spark.createDataFrame([], schemas.RESULT)


def test_names_and_urls(spark):
    rows = repo_ops.with_names(repo_table(spark, [
        ("1", "o/a", "https://github.com/o/other"), ("2", "", "https://github.com/o/b"),
        ("3", None, "http://github.com/o/c/"), ("4", None, None), ("5", "", ""), ("6", "o/f", None),
        ("7", None, "https://github.com/"),
    ])).collect()
    assert {r["id"]: (r["full_name"], r["url"]) for r in rows} == {
        "1": ("o/a", "https://github.com/o/other"), "2": ("o/b", "https://github.com/o/b"),
        "3": ("http://github.com/o/c/", "http://github.com/o/c/"),
        "6": ("o/f", "https://github.com/o/f"),
    }


def test_limit_comes_before_resume(spark):
    repos = repo_table(spark, [(str(i), f"o/{i}", None) for i in range(5)])
    done = spark.createDataFrame([("0",), ("1",)], "repo_id string")
    first = repo_ops.unprocessed(repo_ops.first_repos(repos, 2), done)
    assert first.count() == 0
    assert repo_ops.unprocessed(repo_ops.first_repos(repos, 0), done).count() == 3


def test_latest_successful_metadata(spark):
    rows = repo_ops.latest_metadata(meta_table(spark, [
        ("a", 1, "C", None, 200, T1), ("a", 2, None, "dev", 200, T2), ("b", 9, "C", "x", 404, T2),
        ("c", 5, "C", "x", 200, T1), ("c", 6, "C", "x", 403, T2), ("d", None, None, None, 200, T1),
    ])).collect()
    assert {r["full_name"]: tuple(r)[1:] for r in rows} == {
        "a": (2, None, "dev"), "c": (5, "C", "x"), "d": (0, None, "main"),
    }


def outcome_inputs(spark):
    words = "word " * 12
    repos = repo_table(spark, [
        (k, f"o/{k}", None, "conf", 2020, "title")
        for k in ("nometa", "small", "nosnap", "few", "broken", "good", "edge", "nofiles")
    ] + [("unnamed", None, None)])
    metadata = meta_table(spark, [
        (f"o/{k}", 199 if k == "small" else 200, "Python", "dev", 200, T1)
        for k in ("small", "nosnap", "few", "broken", "good", "edge", "nofiles")
    ])
    snapshots = snap_table(spark, [(k, k != "nosnap", None) for k in
                                   ("small", "nosnap", "few", "broken", "good", "edge", "nofiles")])
    trees = {
        "few": {"a.md": "word " * 9},
        "edge": {"a.md": "word " * 10},
        "broken": {"a.md": words, "b.py": None, "c.js": None},
        "good": {"a.py": "import b\n" + words.replace("word", "x;"), "b.py": "", "c.js": None, "n.csv": words,
                 "node_modules/d.js": words},
        "small": {"a.md": words}, "nosnap": {"a.md": words},
    }
    return repos, metadata, snapshots, files(spark, trees)


def run(spark, staging, stored=None, settings=SMALL, **more):
    repos, metadata, snapshots, table = outcome_inputs(spark)
    rows = repo_run.run(repos, metadata, snapshots, table, stored or empty_results(spark), staging, settings, **more)
    return rows


def test_every_named_repository_has_one_outcome(spark, staging):
    rows = run(spark, staging).collect()
    found = {r["repo_id"]: r for r in rows}
    assert len(rows) == len(found)
    assert {k: (r["processing_status"], r["error_message"]) for k, r in found.items()} == {
        "nometa": ("github_api_failed", None),
        "small": ("skipped", "size_kb=199 < 200"),
        "nosnap": ("clone_failed", "shallow clone failed"),
        "few": ("skipped", "tokens=9 < 10"),
        "nofiles": ("skipped", "tokens=0 < 10"),
        "broken": ("error", "unreadable file: b.py"),
        "edge": ("completed", None),
        "good": ("completed", None),
    }
    good, edge, few = found["good"], found["edge"], found["few"]
    assert good["tokens_by_extension"] == {".py": 26}
    assert (good["total_code_files"], good["unique_internal_imports"], good["num_connected_components"]) == (1, 1, 2)
    assert (good["conference"], good["year"], good["github_size_kb"], good["default_branch"]) == ("conf", 2020, 200, "dev")
    # No graph node at all: counts stay 0, ratios are NULL.
    assert (edge["max_in_degree"], edge["num_connected_components"], edge["graph_density"]) == (0, 0, None)
    assert (few["total_code_tokens"], few["tokens_by_extension"], few["num_connected_components"]) == (0, None, None)
    assert found["nometa"]["github_size_kb"] == 0


def test_packed_files_are_pruned_by_folder(spark, staging):
    repos, metadata, snapshots, table = outcome_inputs(spark)
    path = staging.path("packed")
    tables.pack_files(table, path, buckets=16)
    packed = tables.read_files(spark, path)
    assert sorted(map(tuple, packed.drop("repo_bucket", "content").collect())) == sorted(
        map(tuple, table.drop("content").collect())
    )
    one = staging.save(spark.createDataFrame([("good",)], "repo_id string"), "one")
    pruned = tables.files_of(packed, one.df, 16)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*repo_bucket#\d+ (=|IN)", plan)
    assert {r["repo_id"] for r in pruned.collect()} == {"good"}
    settings = Settings(min_tokens=10, file_buckets=16)
    done = repo_run.run(repos, metadata, snapshots, packed, empty_results(spark), staging, settings)
    plain = run(spark, staging)
    assert sorted(map(tuple, done.select("repo_id", "processing_status", "total_code_tokens").collect())) == sorted(
        map(tuple, plain.select("repo_id", "processing_status", "total_code_tokens").collect())
    )


def test_file_size_bounds_and_big_files_in_graph(spark, staging):
    trees = {"r": {"zero.py": b"", "one.md": b"a", "max.txt": b"a" * 1_000_000, "over.py": b"#" * 1_000_001}}
    from repoloom.operators import files as file_ops, totals

    facts = staging.save(file_ops.file_facts(files(spark, trees), Settings()), "facts").df
    row = totals.token_totals(facts).first()
    assert (row["total_files"], row["total_bytes"]) == (2, 1_000_001)
    assert row["tokens_by_extension"] == {".md": 1, ".txt": 1}
    graphed = {r["path"] for r in facts.filter(F.col("language").isNotNull()).collect()}
    assert graphed == {"zero.py", "over.py"}


def test_counts_of_another_counter_are_refused(spark, staging):
    from repoloom.operators import totals

    facts = spark.createDataFrame(
        [("r", ".py", 60, 1, True, True, "pattern"), ("r", ".py", 70, 2, True, True, "words"),
         ("r", ".md", 5, 3, True, True, "pattern"), ("s", ".py", 1, 1, True, True, "words")],
        "repo_id string, extension string, tokens long, size_bytes long, counted boolean, readable boolean, counter string",
    )
    counted = totals.token_totals(facts)
    found = {(r["repo_id"], r["counter"]): (r["total_tokens"], r["tokens_by_extension"]) for r in counted.collect()}
    assert found == {
        ("r", "pattern"): (65, {".py": 60, ".md": 5}), ("r", "words"): (70, {".py": 70}), ("s", "words"): (1, {".py": 1}),
    }
    few = lambda rows: rows.select(totals.too_few_tokens(F.col("total_tokens"), 65, F.col("counter"), "pattern")).collect()
    assert few(counted.filter("counter = 'pattern'")) == [(False,)]
    with pytest.raises(Exception, match="tokens of counter words at a gate for pattern"):
        few(counted)
    none = spark.createDataFrame([(None, None)], "total_tokens long, counter string")
    assert few(none) == [(True,)]


def test_stored_rows_name_the_counter(spark, staging):
    def words(text):
        return F.size(F.split(text, " "))

    def stored(settings):
        repos, metadata, snapshots, table = outcome_inputs(spark)
        rows = repo_run.run(repos, metadata, snapshots, table, empty_results(spark), staging, settings)
        return {(r["processing_status"] == "completed" and r["total_code_files"] > 0, r["token_counter"]) for r in rows.collect()}

    assert stored(SMALL) == {(True, "pattern"), (False, None)}
    assert stored(Settings(min_tokens=1, token_counter=words)) == {(True, "words"), (False, None)}


def test_second_run_adds_nothing(spark, staging):
    repos, metadata, snapshots, table = outcome_inputs(spark)
    inputs = incremental.Inputs(metadata, snapshots, table)
    path = staging.path("results")
    incremental.run_and_store(spark, repos, inputs, path, SMALL, run="one")
    first = {r["repo_id"]: r.asDict() for r in results.read_results(spark, path).collect()}
    incremental.run_and_store(spark, repos, inputs, path, SMALL)
    second = {r["repo_id"]: r.asDict() for r in results.read_results(spark, path).collect()}
    assert len(first) == 8 and first == second
    # The same run again replaces itself.
    incremental.run_and_store(spark, repos, inputs, path, SMALL, run="one")
    third = {r["repo_id"]: r.asDict() for r in results.read_results(spark, path).collect()}
    drop = lambda rows: {k: {c: v for c, v in r.items() if c != "processed_at"} for k, r in rows.items()}
    assert drop(third) == drop(first)


def test_chosen_statuses_can_be_retried(spark):
    stored = spark.createDataFrame([("a", "completed"), ("b", "error")], "repo_id string, processing_status string")
    assert {r[0] for r in tables.processed_keys(stored).collect()} == {"a", "b"}
    assert {r[0] for r in tables.processed_keys(stored, ("error",)).collect()} == {"a"}


def result_rows(spark, rows):
    base = {f.name: (None if f.nullable else {"string": "", "long": 0, "double": 0.0, "timestamp": T1}[f.dataType.typeName()])
            for f in schemas.RESULT}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schemas.RESULT)


def test_upsert_changes_only_supplied_columns(spark):
    old = result_rows(spark, [
        dict(id="i1", repo_id="1", processing_status="completed", graph_density=0.5, total_code_tokens=7,
             tokens_by_extension={".py": 7}, processed_at=T1),
        dict(id="i2", repo_id="2", processing_status="error", error_message="boom", processed_at=T1),
        dict(id="i3", repo_id="3", processing_status="completed", graph_density=0.25, processed_at=T1),
    ])
    new = result_rows(spark, [
        dict(id="x", repo_id="1", processing_status="error", error_message="later", processed_at=T2),
        dict(id="x", repo_id="2", processing_status="completed", graph_density=0.75, processed_at=T2),
        dict(id="x", repo_id="3", processing_status="completed", graph_density=None, processed_at=T2),
        dict(id="i4", repo_id="4", processing_status="skipped", error_message="e", processed_at=T2),
    ])
    merged = {r["repo_id"]: r for r in results.upsert(old, new).collect()}
    assert sorted(merged) == ["1", "2", "3", "4"]
    one, two, three, four = (merged[k] for k in "1234")
    # A failure keeps measurements it does not supply, and resets those it does.
    assert (one["processing_status"], one["graph_density"], one["total_code_tokens"], one["tokens_by_extension"]) == ("error", 0.5, 0, {".py": 7})
    # A success does not supply error text; the first insert's identity stays.
    assert (two["error_message"], two["graph_density"], two["id"], two["processed_at"]) == ("boom", 0.75, "i2", T1)
    # NULL that is supplied replaces a value.
    assert three["graph_density"] is None
    assert (four["id"], four["processed_at"]) == ("i4", T2)


def test_constraint_report(spark):
    sound = result_rows(spark, [dict(id="1", repo_id="1"), dict(id="2", repo_id="2")])
    assert {r["violations"] for r in results.constraint_violations(sound).collect()} == {0}
    doubled = results.constraint_violations(sound.unionByName(sound)).collect()
    assert {r["rule"]: r["violations"] for r in doubled if r["violations"]} == {"unique repo_id": 2}


def test_summary(spark, staging):
    counts = {r[0]: r[1] for r in outcomes.status_counts(run(spark, staging)).collect()}
    assert counts == {"completed": 2, "skipped": 3, "error": 1, "clone_failed": 1, "github_api_failed": 1}


def test_one_row_for_repeated_repositories_and_snapshots(spark):
    from repoloom.operators import outcomes, repos as repo_ops

    listed = spark.createDataFrame([("a", "o/a", "u1"), ("a", "o/a", "u2"), ("b", "o/b", "u")], "id string, full_name string, url string")
    metadata = spark.createDataFrame([("o/a", 500, None, None), ("o/b", 500, None, None)], "full_name string, size_kb bigint, language string, default_branch string")
    snapshots = spark.createDataFrame([("a", False), ("a", True), ("b", False), ("b", False)], "repo_id string, ok boolean")
    found = outcomes.first_gates(repo_ops.with_names(listed), metadata, snapshots, Settings()).collect()
    assert sorted((r["id"], r["url"], r["early_status"]) for r in found) == [("a", "u2", None), ("b", "u", "clone_failed")]
