"""Scores for a set of repositories, from edges or from file facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.operators import components, graph, resolve, score
from repoloom.settings import Settings
from repoloom.sources.staging import Staging


def metrics_from_edges(
    sources: DataFrame, edges: DataFrame, settings: Settings, staging: Staging
) -> DataFrame:
    """Unrounded metrics per repository.

    `sources` (repo_id, path) are the files that are nodes in any case; `edges`
    (repo_id, src, dst, n) is distinct. Edges feed both the degrees and the
    components, so they are written down once.
    """
    stored = staging.save(edges.select(*schemas.EDGES.fieldNames()), "edges").df
    sizes = components.component_sizes(stored, staging)
    nodes = graph.node_table(sources, stored)
    return score.dependency_metrics(graph.graph_metrics(nodes, sizes), settings.weights)


def metrics_from_facts(facts: DataFrame, settings: Settings, staging: Staging) -> DataFrame:
    """Unrounded metrics per repository from per-file facts (see `file_facts`)."""
    sources = facts.filter(F.col("language").isNotNull()).select("repo_id", "path")
    edges = resolve.all_edges(facts, settings, staging)
    return metrics_from_edges(sources, edges, settings, staging)
