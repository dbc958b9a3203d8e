"""Trees, corpora, serving helpers and staging."""

import json
import os

import pytest
from pyspark.sql import functions as F

from repoloom.operators import sequences, serving
from repoloom.sources import corpus, trees
from repoloom.sources.staging import Staging, checkpoint_root


def test_tree_keeps_hidden_and_underscored_names(spark, tmp_path):
    wanted = {
        ("one", "pkg/__init__.py"): b"x = 1", ("one", ".github/ci.yml"): b"on: push", ("one", "_sub/b.py"): b"",
        ("one", "top.c"): b"\xff\x00", ("two", "a/b/c/d.rs"): b"use crate::a;",
    }
    for (repo, path), content in wanted.items():
        where = tmp_path / repo / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(content)
    listing = trees.list_tree(spark, str(tmp_path))
    assert {(r["repo_id"], r["path"], r["size_bytes"]) for r in listing.collect()} == {
        (repo, path, len(content)) for (repo, path), content in wanted.items()
    }
    loaded = trees.with_content(listing.filter(~F.col("path").endswith(".yml"))).collect()
    assert {(r["repo_id"], r["path"]): bytes(r["content"]) for r in loaded} == {
        k: v for k, v in wanted.items() if not k[1].endswith(".yml")
    }


@pytest.mark.parametrize("walked", [1, 7, 10_000])
def test_tree_of_any_shape(spark, tmp_path, walked):
    """One deep chain, one wide folder, empty folders and links: each file once, however
    little a task may walk before it hands folders back."""
    wanted = {("deep", "/".join(f"d{k}" for k in range(n)) + f"/f{n}.py") for n in range(1, 12)}
    wanted |= {("wide", f"x/y/{k}.c") for k in range(50)} | {("wide", f"x/{k}/z.c") for k in range(20)}
    for repo, path in wanted:
        where = tmp_path / repo / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_text(path)
    (tmp_path / "empty" / "a" / "b").mkdir(parents=True)
    os.symlink(tmp_path / "wide", tmp_path / "deep" / "link")  # a loop, were it followed
    found = trees.list_tree(spark, str(tmp_path), shares=3, walked=walked).collect()
    assert sorted((r["repo_id"], r["path"]) for r in found) == sorted(wanted)


def test_written_trees_are_read_back(spark, tmp_path):
    rows = [("a", "p/q.py", 3, b"abc"), ("a", "p/q.py", 3, b"abc"), ("b", ".hid/_x", 0, b""), ("b", "none", 0, None)]
    files = spark.createDataFrame(rows, "repo_id string, path string, size_bytes bigint, content binary")
    assert sum(r["files"] for r in trees.write_tree(files, str(tmp_path)).collect()) == 3
    loaded = trees.with_content(trees.list_tree(spark, str(tmp_path))).collect()
    assert sorted((r["repo_id"], r["path"], bytes(r["content"])) for r in loaded) == [("a", "p/q.py", b"abc"), ("b", ".hid/_x", b"")]


def test_unreadable_file_has_no_content(spark, tmp_path):
    (tmp_path / "r").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "r" / "gone.py")
    rows = trees.with_content(trees.list_tree(spark, str(tmp_path))).collect()
    assert [(r["path"], r["content"]) for r in rows] == [("gone.py", None)]


def test_corpus_readers(spark, tmp_path):
    texts = ["one\ntwo", "", "ž"]
    lines, array, plain = (str(tmp_path / n) for n in ("c.jsonl", "c.json", "c.txt"))
    with open(lines, "w") as f:
        f.writelines(json.dumps({"text": t, "other": 1}) + "\n" for t in texts)
    with open(array, "w") as f:
        json.dump([{"text": t} for t in texts], f)
    with open(plain, "w") as f:
        f.write("first\n\nthird\n")
    read = lambda *a, **k: sorted(r["text"] for r in corpus.read_corpus(spark, *a, **k).collect())
    assert read(lines) == sorted(texts)
    assert read(array, array_file=True) == sorted(texts)
    assert read(plain) == ["", "first", "third"]


def test_sequences(spark):
    df = spark.createDataFrame([("a b c d", 1), ("", 2)], "text string, other int")
    rows = sequences.tokenize(df, 3).collect()
    assert [r.asDict() for r in rows] == [
        {"input_ids": ["a", "b", "c"], "attention_mask": [1, 1, 1]}, {"input_ids": [], "attention_mask": []},
    ]
    assert sequences.corpus_size(df).first()[0] == 2


def test_ranking_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1)], "repo_id string, v int")
    assert [r[0] for r in serving.top_by(df, "v", 3).collect()] == ["c", "a", "b"]


def test_buckets(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.3,), (1.0,), (None,)], "v double")
    got = [r[0] for r in df.select(serving.bucket(F.col("v"), (0.25, 0.5))).collect()]
    assert got == [0, 1, 1, 2, None]
    ranged = spark.range(1000).withColumn("v", F.col("id").cast("double"))
    shares = serving.quantile_buckets(ranged.union(df.filter("v is null").select(F.lit(0), "v")), "v", 4)
    counts = {r["bucket"]: r["count"] for r in shares.groupBy("bucket").count().collect()}
    assert counts.pop(None) == 1 and set(counts) == {0, 1, 2, 3}
    assert all(abs(n - 250) <= 1 for n in counts.values())


def test_mixture_is_stable_and_near_its_rates(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("b"))
    rates = {0: 0.1, 1: 0.7}
    drawn = serving.mixture(df, "k", "b", rates, seed=3)
    again = serving.mixture(df.repartition(9), "k", "b", rates, seed=3)
    assert {r[0] for r in drawn.collect()} == {r[0] for r in again.collect()}
    counts = {r["b"]: r["count"] for r in drawn.groupBy("b").count().collect()}
    assert set(counts) == {0, 1}
    assert abs(counts[0] - 667) < 100 and abs(counts[1] - 4667) < 200
    assert {r[0] for r in serving.mixture(df, "k", "b", rates, seed=4).collect()} != {r[0] for r in drawn.collect()}


def test_staging_counts_rows_and_cleans_up(spark):
    folder = Staging(spark)
    assert folder.root.startswith(checkpoint_root(spark))
    table = folder.save(spark.range(7), "seven")
    assert table.rows == 7 and table.df.count() == 7
    table.drop()
    with pytest.raises(Exception):
        spark.read.parquet(table.path).count()
    folder.close()


def test_session_setting_names_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert named and Staging(spark).root.startswith(named)


def test_filter_of_fixed_size_keeps_all_wanted_rows(spark):
    from repoloom.operators.prefilter import likely_in

    rows = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("k"), F.col("id").alias("v"))
    wanted = rows.filter("v % 50 = 0").select("k").union(spark.createDataFrame([("none",)], "k string"))
    passed = {r["v"] for r in likely_in(rows, wanted, ["k"]).collect()}
    assert set(range(0, 20_000, 50)) <= passed and len(passed) < 450
    assert likely_in(rows, wanted.limit(0), ["k"]).count() == 0
