"""The interconnection score of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.functions.numbers import round_exact, zero_to_null
from repoloom.settings import ScoreWeights


def score_terms(metrics: DataFrame) -> DataFrame:
    """Add the four terms, each in [0, 1]; meaningful from two nodes on."""
    one = F.lit(1.0)
    log_nodes = F.ln(F.greatest(F.col("nodes"), F.lit(2)).cast("double"))
    return metrics.withColumns(
        {
            "density_term": F.least(F.col("density") * 10, one),
            "in_degree_term": F.least(F.col("avg_in_degree") / log_nodes, one),
            "component_term": F.col("largest_fraction"),
            "edge_term": F.least(F.col("edges").cast("double") / F.col("nodes"), one),
        }
    )


def dependency_metrics(metrics: DataFrame, weights: ScoreWeights = ScoreWeights()) -> DataFrame:
    """Unrounded score and metrics per repository.

    With fewer than two nodes the score and all graph metrics are 0, while the
    import counts stay.
    """
    total = (
        F.lit(weights.density) * F.col("density_term")
        + F.lit(weights.in_degree) * F.col("in_degree_term")
        + F.lit(weights.largest_component) * F.col("component_term")
        + F.lit(weights.edges_per_node) * F.col("edge_term")
    )
    graph = F.col("nodes") >= 2

    def or_zero(column, zero):
        return F.when(graph, column).otherwise(F.lit(zero))

    return score_terms(metrics).select(
        "repo_id",
        or_zero(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 0.0).alias("dependency_score"),
        F.col("occurrences").alias("internal_import_count"),
        F.col("edges").alias("unique_internal_imports"),
        or_zero(F.col("density"), 0.0).alias("graph_density"),
        or_zero(F.col("avg_in_degree"), 0.0).alias("avg_in_degree"),
        or_zero(F.col("max_in_degree"), 0).cast("bigint").alias("max_in_degree"),
        or_zero(F.col("components"), 0).cast("bigint").alias("num_connected_components"),
        or_zero(F.col("largest_fraction"), 0.0).alias("largest_component_fraction"),
    )


def rounded(metrics: DataFrame) -> DataFrame:
    """Stored precision; density, average degree and fraction become NULL at 0."""
    return metrics.withColumns(
        {
            "dependency_score": round_exact(F.col("dependency_score"), 4),
            "graph_density": round_exact(zero_to_null(F.col("graph_density")), 6),
            "avg_in_degree": round_exact(zero_to_null(F.col("avg_in_degree")), 4),
            "largest_component_fraction": round_exact(
                zero_to_null(F.col("largest_component_fraction")), 4
            ),
        }
    )
