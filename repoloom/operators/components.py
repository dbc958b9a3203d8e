"""Weakly connected components of all repositories at once, one way for all sizes.

Edges are brought together by repository and replaced by a spanning forest within chunks of a
bounded size; forests keep what is connected and are no larger than their nodes. A repository
that lies in one chunk is settled by that. A large one is spread over many tasks and chunks; its
forests, and those of the few that a chunk's border cuts, are settled by randomised contraction
over the whole cluster: in each round every node picks
the smallest node among itself and its neighbours under a fresh pseudo-random order, all
nodes with the same pick merge, and edges inside a merged node disappear. Edges shrink
geometrically, so all rounds cost little more than the first. (Boegeholz, Brand, Todor:
"In-database connected component analysis", 2020.) Once at most `FINAL_EDGES` are left, a
bounded number for graphs of any size, one task settles them all: the many rounds over next
to nothing at the end would only cost the start of their jobs.

The tables hold only 64-bit numbers. A node is (r, v): hashes of its repository and its
name. That the pairs are unique is checked, not assumed: there must be as many as names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.sources.staging import StagedTable, Staging

MAX_ROUNDS = 200
# Rounds after which the merged sizes are written down, to keep plans short.
ROUNDS_PER_PLAN = 6
# Edges (24 bytes each) that one task takes at the end.
FINAL_EDGES = 1 << 20
# Edges that a task takes together for a forest.
CHUNK_EDGES = 1 << 20
SEEDS = 5


def component_sizes(
    edges: DataFrame,
    staging: Staging,
    batch_forests: bool = True,
    final_edges: int = FINAL_EDGES,
    chunk_edges: int = CHUNK_EDGES,
) -> DataFrame:
    """(repo_id, size) per component of two nodes or more.

    `edges` (repo_id, src, dst) should be a staged table, as it is read several times.
    """
    links = edges.filter(F.col("src") != F.col("dst")).select("repo_id", "src", "dst")
    names = links.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    for seed in range(SEEDS):
        repos = staging.save(links.select("repo_id").distinct().withColumn("r", _key(seed, "repo_id")), "repos")
        used = [repos]
        result = None
        if repos.df.groupBy("r").count().filter(F.col("count") > 1).isEmpty():
            pairs = links.select(
                _key(seed, "repo_id").alias("r"), _key(seed, "src").alias("s"), _key(seed, "dst").alias("d")
            )
            sizes = _keyed_sizes(pairs, staging, used, batch_forests, final_edges, chunk_edges)
            result = staging.save(sizes.join(repos.df, "r").select("repo_id", "size"), "component-sizes")
            keys = result.df.agg(F.sum("size")).first()[0] or 0
        for table in used:
            table.drop()
        if result and keys == names:
            return result.df
    raise RuntimeError("node keys are not unique under any tried seed")


def _keyed_sizes(
    pairs: DataFrame, staging: Staging, used: list[StagedTable], batch_forests: bool, final_edges: int, chunk_edges: int
) -> DataFrame:
    """(r, size) per component of the links (r, s, d); tables to drop later go to `used`."""
    if batch_forests:
        stars = _chunk_forests(pairs, chunk_edges)
        stars = staging.save(stars, "stars")
        used.append(stars)
        cut = stars.df.select("r", "chunk").distinct().groupBy("r").count().filter(F.col("count") > 1).select("r")
        cut = staging.save(cut, "cut")
        used.append(cut)
        whole = stars.df.join(cut.df, "r", "left_anti").groupBy("r", "root").agg((F.count(F.lit(1)) + 1).alias("size"))
        rest = stars.df.join(cut.df, "r", "left_semi").select("r", F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b"))
        whole, graph, rows = whole.select("r", "size"), rest, rest.count() if cut.rows else 0
    else:
        table = staging.save(_undirected(pairs), "pairs")
        used.append(table)
        whole, graph, rows = None, table.df, table.rows
    sizes = None
    masks = random.Random(20240501)
    rounds = 0
    while rows > final_edges:
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
        rounds += 1
        scrambled = _scrambler(masks)
        pick = staging.save(_picks(graph, scrambled), "picks")
        moved = _contract(graph, pick.df)
        smaller = staging.save(_undirected(_forests(moved) if batch_forests else moved), "pairs")
        used += [smaller, pick]
        graph, rows = smaller.df, smaller.rows
        sizes = _merge_sizes(sizes, pick.df, scrambled)
        if rounds % ROUNDS_PER_PLAN == 0:
            merged = staging.save(sizes, "sizes")
            used.append(merged)
            sizes = merged.df
    if rows:
        pick = staging.save(graph.coalesce(1).mapInArrow(_settled, "r bigint, v bigint, pick bigint"), "picks")
        used.append(pick)
        sizes = _merge_sizes(sizes, pick.df, lambda v: v)
    parts = [part.select("r", "size") for part in (whole, sizes) if part is not None]
    return reduce(DataFrame.unionByName, parts) if parts else graph.select("r", F.lit(0).cast("bigint").alias("size"))


def _trees(r, s, d):
    """(r, node, root) of all nodes that the edges (r, s, d) name: arrays of equal length,
    where nodes have the same root if and only if they are connected."""
    import numpy as np

    ends_r, ends = np.concatenate([r, r]), np.concatenate([s, d])
    order = np.lexsort((ends, ends_r))
    ends_r, ends = ends_r[order], ends[order]
    new = np.append(True, (ends_r[1:] != ends_r[:-1]) | (ends[1:] != ends[:-1]))[: len(ends)]
    code = np.empty(len(ends), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    first, second = code[: len(r)], code[len(r) :]
    label = np.arange(int(new.sum()))
    while (label[first] != label[second]).any():
        a, b = label[first], label[second]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    names = ends[new]
    return ends_r[new], names, names[label]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, s, d): for every node of a batch an edge to the first node of its tree there."""
    for batch in batches:
        r, node, root = _trees(*(batch.column(name).to_numpy() for name in ("r", "s", "d")))
        moved = node != root
        yield pa.RecordBatch.from_arrays(
            [pa.array(r[moved]), pa.array(node[moved]), pa.array(root[moved])], names=["r", "s", "d"]
        )


def _chunk_forests(pairs: DataFrame, chunk_edges: int) -> DataFrame:
    """(r, node, root, chunk): every node of a chunk but the roots of its trees.

    Rows are brought together by repository; the planner splits a repository with a large
    share of all edges (`rebalance`), and a task takes `chunk_edges` at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held, rows = [], 0

        def forest() -> pa.RecordBatch:
            r, node, root = _trees(*(np.concatenate(column) for column in zip(*held)))
            moved = node != root
            columns = [r[moved], node[moved], root[moved], np.full(int(moved.sum()), chunk)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["r", "node", "root", "chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk_edges):
                part = batch.slice(at, chunk_edges)
                held.append([part.column(name).to_numpy() for name in ("r", "s", "d")])
                rows += part.num_rows
                if rows >= chunk_edges:
                    yield forest()
                    held, rows, chunk = [], 0, chunk + 1
        if held:
            yield forest()

    near = pairs.hint("rebalance", "r").sortWithinPartitions("r")
    return near.mapInArrow(run, "r bigint, node bigint, root bigint, chunk bigint")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, v, pick) of all nodes of the last edges, which the caller bounds."""
    import numpy as np

    held = [[batch.column(name).to_numpy() for name in ("r", "a", "b")] for batch in batches]
    if held:
        found = _trees(*(np.concatenate(column) for column in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["r", "v", "pick"])


def _forests(pairs: DataFrame) -> DataFrame:
    return pairs.mapInArrow(_forest_batches, "r bigint, s bigint, d bigint")


def _key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _scrambler(masks: random.Random):
    """A one-to-one scrambling of 64-bit numbers: a mask, then xor with shifts."""
    mask = masks.getrandbits(63)
    left, right, again = masks.choice([(13, 7, 17), (5, 15, 27), (11, 31, 18), (17, 23, 29)])

    def scrambled(v: Column) -> Column:
        v = v.bitwiseXOR(F.lit(mask))
        v = v.bitwiseXOR(F.shiftleft(v, left))
        v = v.bitwiseXOR(F.shiftrightunsigned(v, right))
        return v.bitwiseXOR(F.shiftleft(v, again))

    return scrambled


def _undirected(pairs: DataFrame) -> DataFrame:
    """(r, a, b) with a < b, each pair once, no loops."""
    return (
        pairs.filter(F.col("s") != F.col("d"))
        .select("r", F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"))
        .distinct()
    )


def _picks(graph: DataFrame, scrambled) -> DataFrame:
    """(r, v, pick): the node that each linked node merges into.

    A minimum over numbers, so a hub's neighbours collapse before the shuffle.
    """
    seen = graph.select("r", F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
        graph.select("r", F.col("b").alias("v"), F.col("a").alias("u"))
    )
    return (
        seen.groupBy("r", "v")
        .agg(F.min(scrambled(F.col("u"))).alias("best"))
        .select("r", "v", F.least("best", scrambled(F.col("v"))).alias("pick"))
    )


def _contract(graph: DataFrame, pick: DataFrame) -> DataFrame:
    """Rename both ends of every edge to their picks.

    Edges and picks are both staged tables, so each join is two plain shuffles;
    the planner can broadcast small picks and split the edges of a hub.
    """
    left = pick.select("r", F.col("v").alias("a"), F.col("pick").alias("s"))
    right = pick.select("r", F.col("v").alias("b"), F.col("pick").alias("d"))
    return graph.join(left, ["r", "a"]).join(right, ["r", "b"]).select("r", "s", "d")


def _merge_sizes(sizes: DataFrame | None, pick: DataFrame, scrambled) -> DataFrame:
    """(r, v, size) after the picks. The first picks name every node; later a node without a
    pick belongs to a component that is complete and just moves on to the new numbering."""
    if sizes is None:
        return pick.groupBy("r", F.col("pick").alias("v")).agg(F.count(F.lit(1)).alias("size"))
    moved = sizes.join(pick, ["r", "v"], "left").withColumn(
        "v", F.coalesce("pick", scrambled(F.col("v")))
    )
    return moved.groupBy("r", "v").agg(F.sum("size").alias("size"))
