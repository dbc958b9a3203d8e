"""Small inputs for the tests."""

from __future__ import annotations

from repoloom import schemas
from repoloom.operators import files as file_ops
from repoloom.plans import graph_plan
from repoloom.settings import Settings


def file_rows(trees):
    """{repo: {path: text or bytes or None}} -> rows of the file contract."""
    rows = []
    for repo, tree in trees.items():
        for path, content in tree.items():
            data = content.encode() if isinstance(content, str) else content
            rows.append((repo, path, len(data or b""), None if data is None else bytearray(data)))
    return rows


def files(spark, trees):
    return spark.createDataFrame(file_rows(trees), schemas.FILES)


def metrics(spark, staging, trees, settings=Settings(), partitions=None):
    """{repo: row} of unrounded metrics."""
    table = files(spark, trees)
    if partitions:
        table = table.repartition(partitions)
    facts = staging.save(file_ops.file_facts(table, settings), "facts").df
    found = graph_plan.metrics_from_facts(facts, settings, staging)
    return {row["repo_id"]: row for row in found.collect()}


def all_edges(spark, trees, settings=Settings()):
    """{repo: {(src, dst): n}}."""
    from repoloom.operators import resolve

    facts = file_ops.file_facts(files(spark, trees), settings)
    found = {repo: {} for repo in trees}
    for e in resolve.all_edges(facts, settings).collect():
        found[e["repo_id"]][e["src"], e["dst"]] = e["n"]
    return found
