"""Whitened rows against a dense computation of the whole table."""

import math
import os
import random

import numpy as np
import pytest

from repoloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, row long, x int, block string, k int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 5, 6, "b", 7) for i, v in rows], SCHEMA)


def dense(rows, components=4):
    """([(vec_id, x)], n, sums, covariance, eigenvalues, eigenvectors)."""
    kept = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    kept = [(i, [math.floor(256 * float(np.float32(e))) for e in v]) for i, v in kept]
    fit = sorted(set(tuple(x) for _, x in kept))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array(fit, dtype=float) - np.array(sums) / n
    covariance = centre.T @ centre / n
    values, vectors = np.linalg.eigh(covariance)
    return kept, n, sums, covariance, values[::-1][:components], vectors[:, ::-1][:, :components]


def check(found, rows, components=4):
    kept, n, sums, covariance, values, vectors = dense(rows, components)
    k = len(values)
    assert len(found) == len(kept) * k
    wanted = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        wanted.setdefault(i, []).append((deviation, (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)))
    signs = {}
    for row in found:
        c = row["component"] - 1
        assert row["n"] == n
        assert row["explained"] == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
        assert 0 <= row["identity_error"] < 1e-8
        matches = [y[c] for d, y in wanted[row["vec_id"]] if d == row["deviation"]]
        assert matches
        close = [s for s in (1, -1) for y in matches if abs(y - s * row["whitened"]) < 1e-7]
        assert close
        if abs(row["whitened"]) > 1e-3 and len(matches) == 1:
            assert signs.setdefault(c, close[0]) == close[0]


def vectors(rng, n, width):
    return [(i, [rng.gauss(0, 1 + 2 * k) for k in range(width)]) for i in range(n)]


@pytest.mark.parametrize("height", [3, 16, None])
def test_equals_dense(spark, height):
    rng = random.Random(4)
    rows = vectors(rng, 150, 6)
    rows += [(i + 1000, rows[0][1]) for i in range(70)]  # one common vector
    rows += [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [])]
    rows += [(None, [0.5] * 6), (7, [0.25] * 6)]  # null and repeated ids
    found = whitening.whiten(table(spark, rows).repartition(5), rows_per_block=height).collect()
    check(found, rows)


def test_few_dimensions_and_few_rows(spark):
    rng = random.Random(9)
    rows = vectors(rng, 40, 2)
    check(whitening.whiten(table(spark, rows)).collect(), rows)
    rows = vectors(rng, 3, 5)  # at most two directions vary
    found = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in found} == {1, 2} and len(found) == 6
    assert max(r["identity_error"] for r in found) < 1e-6


def test_nothing_varies(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_most_frequent_length_stays(spark):
    rng = random.Random(2)
    rows = vectors(rng, 30, 5)
    found = whitening.whiten(table(spark, rows + [(100 + i, [float(i), 1.0]) for i in range(5)])).collect()
    check(found, rows)


def test_exact_deviations():
    x = np.array([[2**40, -(2**40)], [3, 4]])
    sums = [2**41, 7]
    wanted = [sum((5 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 5, sums) == [None if w > 2**63 - 1 else w for w in wanted]
    small = np.array([[1, -2], [3, 4]])
    assert whitening.deviations(small, 3, [4, 2]) == [1 + 64, 25 + 100]
    assert whitening.deviations(small[:0], 3, [4, 2]) == []


def test_query_on_supplied_vectors(spark):
    from repoloom.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("supplied tables not present")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, folder).collect(), rows)
