"""Graph and score goldens worked out by hand, and components against union-find."""

import random
from collections import Counter

import pytest
from helpers import metrics
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.operators import components, score
from repoloom.sources.staging import Staging


def summary(row):
    return (
        row["internal_import_count"], row["unique_internal_imports"], row["max_in_degree"],
        row["num_connected_components"], round(row["dependency_score"], 4),
    )


BASE = {"a.js": "import x from './b'", "b.js": "", "c.py": "import d", "d.py": ""}
SELF = "import a from './x.js'\n"
GOLDENS = {
    "mixed": (
        {"src/__init__.py": "", "src/a.py": "import src.b\nimport os", "src/b.py": "",
         "app.js": "import u from './util'"},
        (2, 2, 1, 3, 0.5121),
    ),
    "lone file": ({"main.c": "int main;"}, (0, 0, 0, 0, 0.0)),
    "only a self import": ({"x.js": SELF * 2}, (2, 1, 0, 0, 0.0)),
    "dense pair": ({"a.h": '#include "a.h"', "b.c": '#include "a.h"'}, (2, 2, 2, 1, 1.0)),
    "target without a file": ({"a.c": '#include "gone.h"'}, (1, 1, 1, 1, 0.8303)),
    "relative import": ({"p/a.py": "from .b import x\nfrom . import c", "p/b.py": ""}, (0, 0, 0, 2, 0.15)),
    "package wins": ({"p.py": "", "p/__init__.py": "", "q.py": "import p"}, (1, 1, 1, 2, 0.5925)),
    "from-import": ({"q.py": "from p import m", "p/m.py": ""}, (0, 0, 0, 2, 0.15)),
    "bad Python": ({"a.py": "import (", "b.py": "import a\0", "c.py": "\ufeffimport a"}, (0, 0, 0, 3, 0.1)),
    "languages share a node": ({"a.rs": "use crate::util;", "b.js": "import u from './util'"}, (2, 2, 2, 1, 0.835)),
    "base": (BASE, None),
    "one more file": (dict(BASE, **{"lonely.rs": ""}), None),
    "statement twice": (dict(BASE, **{"a.js": BASE["a.js"] + "\n" + BASE["a.js"]}), None),
}
TREES = {name: tree for name, (tree, _) in GOLDENS.items()}


@pytest.fixture(scope="module")
def found(spark):
    folder = Staging(spark)
    yield metrics(spark, folder, TREES)
    folder.close()


@pytest.mark.parametrize("name", [n for n, (_, expected) in GOLDENS.items() if expected])
def test_golden(found, name):
    assert summary(found[name]) == GOLDENS[name][1]


def test_ratios(found):
    def ratios(name):
        row = found[name]
        return row["graph_density"], row["avg_in_degree"], row["largest_component_fraction"]

    assert ratios("mixed") == (0.1, 0.4, 0.4)
    assert ratios("lone file") == (0, 0, 0)
    assert ratios("dense pair") == (1.0, 1.0, 1.0)


def test_metamorphic(spark, staging, found):
    again = metrics(spark, staging, TREES, partitions=7)
    assert {k: v.asDict() for k, v in found.items()} == {k: v.asDict() for k, v in again.items()}
    base, more, twice = found["base"], found["one more file"], found["statement twice"]
    assert more["num_connected_components"] == base["num_connected_components"] + 1
    assert twice["internal_import_count"] == base["internal_import_count"] + 1
    assert twice["unique_internal_imports"] == base["unique_internal_imports"]


# --- Components ----------------------------------------------------------------------


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for repo, a, b in pairs:
        if a != b:
            parent[find((repo, a))] = find((repo, b))
    sizes = Counter(find(x) for x in list(parent))
    return sorted((root[0], n) for root, n in sizes.items())


def graphs():
    pick = random.Random(6)
    pairs = [("path", f"n{i}", f"n{i + 1}") for i in range(300)]
    pairs += [("hub", "center", f"leaf{i}") for i in range(400)]
    pairs += [("loops", f"a{i}", f"a{i}") for i in range(3)] + [("loops", "a1", "a2")]
    for repo, n, m in (("sparse", 300, 220), ("dense", 40, 300), ("twin", 200, 260)):
        pairs += [(repo, f"v{pick.randrange(n)}", f"v{pick.randrange(n)}") for _ in range(m)]
    return sorted(set(pairs))


@pytest.mark.parametrize("batch_forests, final_edges", [(True, 0), (False, 0), (False, 200), (True, 1 << 20), (False, 1 << 20)])
def test_component_sizes_like_union_find(spark, staging, batch_forests, final_edges):
    pairs = graphs()
    table = spark.createDataFrame([(*p, 1) for p in pairs], schemas.EDGES).repartition(3)
    sizes = components.component_sizes(table, staging, batch_forests, final_edges)
    assert sorted((r["repo_id"], r["size"]) for r in sizes.collect()) == union_find(pairs)


@pytest.mark.parametrize("chunk_edges, cut", [(1 << 20, False), (100, True), (7, True)])
def test_a_repository_in_one_chunk_needs_no_round(spark, staging, monkeypatch, chunk_edges, cut):
    pairs = graphs()
    table = spark.createDataFrame([(*p, 1) for p in pairs], schemas.EDGES).repartition(3)
    picked = []
    monkeypatch.setattr(components, "_picks", lambda graph, *rest: (picked.append({r["r"] for r in graph.collect()}), _picks(graph, *rest))[1])
    sizes = components.component_sizes(table, staging, final_edges=0, chunk_edges=chunk_edges)
    assert sorted((r["repo_id"], r["size"]) for r in sizes.collect()) == union_find(pairs)
    assert bool(picked) == cut
    if chunk_edges == 100:
        assert len(picked[0]) < len({repo for repo, *_ in pairs}) + 1


_picks = components._picks


@pytest.mark.parametrize("clashing", ["nodes", "repositories"])
def test_keys_that_clash_are_tried_again(spark, staging, monkeypatch, clashing):
    pairs = [(repo, f"v{k}", f"v{k + 1}") for repo in ("one", "two") for k in range(0, 60, 2)] + [("three", "v1", "v2")]

    def narrow(seed, *columns):
        key = F.xxhash64(F.lit(seed), *columns)
        return F.pmod(key, F.lit(20 if clashing == "nodes" else 1)) if seed == 0 and (columns == ("repo_id",)) == (clashing == "repositories") else key

    monkeypatch.setattr(components, "_key", narrow)
    table = spark.createDataFrame([(*p, 1) for p in pairs], schemas.EDGES)
    sizes = components.component_sizes(table, staging)
    assert sorted((r["repo_id"], r["size"]) for r in sizes.collect()) == union_find(pairs)


def test_prefixes_are_bounded_by_the_index(spark):
    """A name of 10,000 parts costs no more rows than the deepest module has parts."""
    from repoloom.operators import resolve

    index = spark.createDataFrame([("r", "a", "a.py"), ("r", "a.b.c", "a/b/c.py"), ("s", "a", "a.py")], "repo_id string, module string, path string")
    long = ".".join(["a", "b", "c"] + ["x"] * 9_997)
    names = spark.createDataFrame([("r", long), ("r", "a.b"), ("r", "z"), ("s", long), ("t", "a")], "repo_id string, name string")
    found = {(r["repo_id"], len(r["name"])): r["dst"] for r in resolve.longest_prefix_targets(names, index).collect()}
    assert found == {("r", len(long)): "a/b/c.py", ("r", 3): "a.py", ("s", len(long)): "a.py"}
    cut = resolve.with_dotted_prefixes(names.filter(F.length("name") > 9).withColumn("deepest", F.lit(3)), F.col("deepest"))
    assert sorted({r["module"] for r in cut.collect()}) == ["a", "a.b", "a.b.c"] and cut.count() == 6


def test_no_edges_at_all(spark, staging):
    empty = spark.createDataFrame([], schemas.EDGES)
    assert components.component_sizes(empty, staging).collect() == []


def test_stored_precision(spark):
    row = (0.5, 0.0, 0.03125, 0.66665)
    names = "dependency_score double, graph_density double, avg_in_degree double, largest_component_fraction double"
    got = score.rounded(spark.createDataFrame([row], names)).first()
    assert tuple(got) == (0.5, None, round(0.03125, 4), round(0.66665, 4))


def test_filters_stay_above_the_texts_of_the_code_files(spark, tmp_path):
    from repoloom.operators import files as file_ops
    from repoloom.plans import views
    from repoloom.settings import Settings

    spark.createDataFrame([(k,) for k in [*range(2000), None]], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    chosen = file_ops.relevant(views.code_files(spark, str(tmp_path)), Settings())
    below = chosen._jdf.queryExecution().executedPlan().toString().split("RoundRobinPartitioning", 1)[1]
    assert " Filter (" not in below
    # Every fifth file lies in the pruned folder; all others are routed or counted.
    found = sorted(row["path"] for row in chosen.select("path").collect())
    assert len(found) == 1600 and not any(path.startswith("data/") for path in found)
