"""Per-repository graph tables and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_table(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node, in_degree, occurrences), a row per node.

    Nodes are all given source files plus every edge target, whether a file of
    that name exists or not. `edges` is distinct on (repo_id, src, dst), so one
    grouping settles the node set and the in-degrees together.
    """
    own = sources.select(
        "repo_id", F.col("path").alias("node"),
        F.lit(0).cast("bigint").alias("in_degree"), F.lit(0).cast("bigint").alias("occurrences"),
    )
    pointed = edges.select(
        "repo_id", F.col("dst").alias("node"),
        F.lit(1).cast("bigint").alias("in_degree"), F.col("n").alias("occurrences"),
    )
    return (
        own.unionByName(pointed)
        .groupBy("repo_id", "node")
        .agg(F.sum("in_degree").alias("in_degree"), F.sum("occurrences").alias("occurrences"))
    )


def density(nodes: Column, edges: Column) -> Column:
    """Share of the possible directed edges; NULL below two nodes."""
    return F.try_divide(edges.cast("double"), (nodes * (nodes - 1)).cast("double"))


def degree_metrics(nodes: DataFrame) -> DataFrame:
    """Counts and degree metrics per repository, from the node table."""
    return (
        nodes.groupBy("repo_id")
        .agg(
            F.count(F.lit(1)).alias("nodes"),
            F.sum("in_degree").alias("edges"),
            F.sum("occurrences").alias("occurrences"),
            F.max("in_degree").alias("max_in_degree"),
        )
        .withColumns(
            {
                "density": density(F.col("nodes"), F.col("edges")),
                "avg_in_degree": F.col("edges").cast("double") / F.col("nodes"),
            }
        )
    )


def component_metrics(sizes: DataFrame) -> DataFrame:
    """Number of components and the size of the largest, from component sizes."""
    return sizes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("linked_components"),
        F.max("size").alias("linked_largest"),
        F.sum("size").alias("linked_nodes"),
    )


def graph_metrics(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Degree metrics joined with components; `sizes` covers linked nodes only, the
    others are components of one."""
    joined = degree_metrics(nodes).join(component_metrics(sizes), "repo_id", "left")
    single = F.col("nodes") - F.coalesce("linked_nodes", F.lit(0))
    largest = F.greatest(F.coalesce("linked_largest", F.lit(1)), F.lit(1))
    return joined.withColumns(
        {
            "components": F.coalesce("linked_components", F.lit(0)) + single,
            "largest_fraction": largest.cast("double") / F.col("nodes"),
        }
    ).drop("linked_components", "linked_largest", "linked_nodes")
