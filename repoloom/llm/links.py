"""Connected components of link tables, by alternating star contraction.

Every round replaces links by links to smaller ids (first from larger neighbours, then from
smaller ones) until each node hangs on the smallest id of its component. A round is two
aggregations with partial sums and two equality joins, so a hub's links are never gathered
in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.tables import stage

MAX_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); ids without links are not listed."""
    edges = stage(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).distinct()
        before = after
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(
            hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
