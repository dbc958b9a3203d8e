"""Chosen-path search against all pairs."""

import random

import pytest

from pyspark.sql import functions as F

from repoloom.llm import near_dedup
from repoloom.llm.links import components
from samples import frame, edited, prose


def brute(rows, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets.setdefault(i, set()).add(frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset())
    found = {i: i for i in sets}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= percent * len(x | y):
                            low, high = sorted((root(a), root(b)))
                            found[high] = low
    return {i: (len(next(iter(sets[i]))), root(i)) for i in ids}


def documents():
    rng = random.Random(3)
    rows = []
    for base in range(25):
        text = prose(rng, rng.choice([3, 5, 40, 150, 300]))
        rows.append((len(rows), text))
        for _ in range(rng.choice([0, 1, 4])):
            rows.append((len(rows), edited(rng, text, rng.choice([0, 1, 2, 6]))))
    hub = prose(rng, 200)
    rows += [(1000 + k, edited(rng, hub, rng.choice([1, 2, 3, 5]))) for k in range(60)]
    rows.append((999, hub))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "Word"), (2004, "word"), (2005, hub.upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("node_size", [4, 64, 1024])
def test_components_match_all_pairs(spark, node_size):
    rows = documents()
    found = near_dedup.near_duplicates(frame(spark, rows), 85, node_size=node_size).collect()
    want = brute(rows, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (5, text), (5, text), (4, text)]
    found = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert found == [("4", 4, True), ("5", 4, False), ("5", 4, False), ("None", None, True)]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    left = near_dedup.keep_first(frame(spark, rows))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["4", "None"]
    assert left.columns == frame(spark, []).columns


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200, 202: 200}


def test_estimates_are_close(spark):
    """Sketches of sets of all sizes err by far less than the slack allows."""
    import numpy as np
    from pyspark.sql import functions as F

    from repoloom.llm import textbytes

    rng = np.random.default_rng(4)
    rows = []
    for size in (3, 60, 250, 1000, 5000):
        for _ in range(60):
            share = int(size * 0.08)
            common = rng.integers(0, 1 << 62, size).astype(np.uint64)
            sets = [np.unique(textbytes.mix(np.concatenate([common, rng.integers(0, 1 << 62, share).astype(np.uint64)]))) for _ in range(2)]
            exact = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            one, two = (near_dedup.sketch(s, np.array([0, len(s)]))[0].tolist() for s in sets)
            rows.append((size, exact, tuple(one), tuple(two)))
    shape = "struct<" + ",".join(f"{name}:bigint" for name in near_dedup._SKETCH) + ">"
    found = spark.createDataFrame(rows, f"size int, exact double, x {shape}, y {shape}")
    errors = found.select("size", (near_dedup._estimate("x", "y") - F.col("exact")).alias("e")).toPandas()
    assert errors.groupby("size").e.std().max() < near_dedup.SLACK / 3.3
    assert errors.e.abs().max() < 1.3 * near_dedup.SLACK


@pytest.mark.parametrize("common,extra,pairs", [(4, 1, 6000), (8, 2, 6000), (4000, 1000, 6000)])
def test_no_pair_at_the_threshold_fails_the_estimate(spark, common, extra, pairs):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    rng = np.random.default_rng(common)
    small, large = [], []
    for _ in range(pairs):
        members = rng.integers(0, 1 << 64, common + extra, dtype=np.uint64)
        for found, part in ((small, members[:common]), (large, members)):
            found.append(near_dedup.sketch(np.sort(part), np.array([0, len(part)]))[0])
    names = [f"{side}_{name}" for side in "xy" for name in near_dedup._SKETCH]
    rows = spark.createDataFrame(pd.DataFrame(np.concatenate([small, large], axis=1), columns=names))
    side = lambda s, n: F.struct(F.lit(n).alias("n"), *(F.col(f"{s}_{name}").alias(name) for name in near_dedup._SKETCH)).alias(s)
    rows = rows.select(side("x", common), side("y", common + extra))
    assert rows.filter(near_dedup._alike("x", "y", 80)).count() == pairs


def crowd(rng, size, words, noise):
    """Texts that differ from one template in `noise` words of their own each."""
    template = prose(rng, words)
    return [(k, edited(rng, template, noise)) for k in range(size)]


def test_shared_counts_and_forest():
    import numpy as np

    rng = np.random.default_rng(6)
    one, two = ([np.unique(rng.integers(0, top, n)).astype(np.uint64) for n, top in shape] for shape in (
        [(40, 50), (3, 9), (500, 5000), (1, 2)] * 20, [(30, 50), (600, 5000), (2, 2)] * 30))
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    found = near_dedup.shared_counts(*flat(one), *flat(two))
    assert found.tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    assert near_dedup.shared_counts(*none, 2, *flat(two)).sum() == 0

    linked = rng.random((60, 60)) < 0.02
    linked |= linked.T
    forest = near_dedup.spanning_forest(linked)
    assert all(linked[a, b] for a, b in forest)
    parts = lambda links: len({frozenset(c) for c in _components(60, links)})
    assert parts(forest) == parts(list(zip(*np.nonzero(linked)))) == 60 - len(forest)


def _components(n, links):
    groups = [{k} for k in range(n)]
    for a, b in links:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for k in groups[b]:
                groups[k] = groups[a]
    return groups


@pytest.mark.parametrize("blocks", [16, 512])
def test_crowds_below_and_at_the_threshold(spark, monkeypatch, blocks):
    """Nearly all pairs pass the estimate; few of them are links."""
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", blocks)
    rng = random.Random(11)
    rows = crowd(rng, 120, 300, 7)
    rows += [(500 + k, edited(rng, rows[k][1], 3)) for k in range(0, 60, 5)] + [(900, None), (None, rows[0][1]), (901, rows[3][1])]
    paired = []
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: (paired.append(pairs.count()), confirmed(pairs, *rest))[1])
    found = near_dedup.near_duplicates(frame(spark, rows), 85).collect()
    want = brute([r for r in rows if r[0] is not None], 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    assert len({c for _, c in want.values()}) > 60 and sum(paired) < 60 * len(rows)


@pytest.mark.parametrize("width", [40, 1024])
def test_pairs_of_a_crowd_never_become_rows(spark, monkeypatch, width):
    """Rows from the comparison grow with the classes of a node, not with its pairs."""
    monkeypatch.setattr(near_dedup, "COMPARED_CLASSES", width)
    rng = random.Random(12)
    rows = crowd(rng, 150, 300, 7) + [(500 + k, prose(rng, 60)) for k in range(20)]
    rows += [(600 + k, edited(rng, rows[150 + k][1], 1)) for k in range(10)]
    compared = []
    monkeypatch.setattr(near_dedup, "_links", lambda found, *rest: (compared.append(found.count()), _links(found, *rest))[1])
    found = near_dedup.near_duplicates(frame(spark, rows), 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 85)
    # One node holds the crowd first in one of the trees; in smaller blocks each is judged by itself.
    assert compared[0] < 5 * len(rows)


def test_arrays_pass_the_same_pairs(spark):
    """The estimate of arrays and that of columns agree on every pair."""
    import numpy as np
    import pyarrow as pa

    from repoloom.llm import textbytes

    rng = random.Random(13)
    texts = [t for size in (3, 20, 60, 70, 400) for _, t in crowd(rng, 12, size, max(1, size // 40))]
    values, first = near_dedup.shingle_sets(*textbytes.text_buffers(pa.array(texts)))
    sketches = near_dedup.sketch(values, first)
    table = pa.table({"id": np.arange(len(texts)), "n": np.diff(first), **dict(zip(near_dedup._SKETCH, sketches.T))})
    rows = spark.createDataFrame(table.to_pandas())
    for percent in (80, 85):
        want = rows.alias("x").crossJoin(rows.alias("y")).filter(near_dedup._alike("x", "y", percent)).selectExpr("x.id a", "y.id b").collect()
        passed = near_dedup._passing(table, table, percent)
        assert sorted(zip(*map(np.ndarray.tolist, np.nonzero(passed)))) == sorted((r["a"], r["b"]) for r in want)


def test_the_plan_of_the_pairs_is_not_repeated(spark):
    """Confirming reads pairs several times, but does not plan what made them again."""
    texts = frame(spark, [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "h i j k l m n"), (None, "a b c d e f g"), (2, "A b c d e f g")])
    pairs = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (1, 2, 1), (None, 2, 1)], "a long, b long, kind int")
    pairs = pairs.groupBy("a", "b").agg(F.max("kind").alias("kind")).filter("kind >= 0").select("a", "b")
    links = near_dedup.confirmed(pairs, near_dedup.ids_and_texts(texts), 80)
    assert "max(" not in links._jdf.queryExecution().executedPlan().toString()
    assert [(r["a"], r["b"]) for r in links.collect()] == [(1, 2)]


confirmed = near_dedup.confirmed
_links = near_dedup._links
