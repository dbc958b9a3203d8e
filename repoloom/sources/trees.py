"""Source trees on a shared mount as a table of files.

Spark's own file listing hides names that start with `_` or `.`, which loses
`__init__.py` and hidden folders, so trees get a listing of their own: a frontier of folders
that a Spark job expands, again and again until no folder is left. A task walks down from
each folder it was dealt until it has seen `WALKED` entries and hands what is left back to
the frontier, which is dealt anew by folder. A small tree is done in one job; a large one is
shared out wherever its files lie, also if all of them are far below a single folder. Bytes
are read only for the rows that survive filters, in chunks bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.sources.staging import Staging

SOURCE_NAME = "repository_folders"
WALKED = 10_000
LISTED_ROWS = 10_000
HELD_BYTES = 64 << 20


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("repository_folders").load(root)` available: (repo_id) for
    every folder in root. Each task lists the names of its own share, chosen by a hash, so
    the driver sees none."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    # Local classes travel to the workers by value; no package install needed there.
    class Share(InputPartition):
        def __init__(self, number: int):
            self.number = number

    class Folders(DataSourceReader):
        def __init__(self, root: str, shares: int):
            self.root = root
            self.shares = shares

        def partitions(self):
            return [Share(i) for i in range(self.shares)]

        def read(self, part):
            import os
            import zlib

            with os.scandir(self.root) as found:
                for repo in found:
                    if zlib.crc32(os.fsencode(repo.name)) % self.shares == part.number and repo.is_dir():
                        yield (repo.name,)

    class RepositoryFolders(DataSource):
        @classmethod
        def name(cls):
            return SOURCE_NAME

        def schema(self):
            return "repo_id string"

        def reader(self, schema):
            return Folders(self.options["path"], int(self.options["shares"]))

    spark.dataSource.register(RepositoryFolders)


def _expanded(root: str, walked: int):
    """Files below the given folders (repo_id, path), and folders that are still to expand."""
    columns = ["repo_id", "path", "size_bytes", "location", "folder"]

    def walk(repo: str, start: str):
        import os

        left, seen = [start], 0
        while left:
            at = left.pop()
            if seen >= walked:
                yield repo, at, 0, "", True
                continue
            with os.scandir(os.path.join(root, repo, at)) as found:
                for entry in found:
                    seen += 1
                    path = os.path.join(at, entry.name)
                    if entry.is_dir(follow_symlinks=False):
                        left.append(path)
                    elif not entry.is_dir():  # a link to a folder is not followed
                        try:
                            size = entry.stat().st_size
                        except OSError:
                            size = 0
                        yield repo, path, size, entry.path, False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import batched

        import pandas

        for batch in batches:
            rows = (row for folder in batch.itertuples(index=False) for row in walk(folder.repo_id, folder.path))
            for chunk in batched(rows, LISTED_ROWS):
                yield pandas.DataFrame(list(chunk), columns=columns)

    return run


def list_tree(
    spark: SparkSession, root: str, shares: int | None = None, staging: Staging | None = None, walked: int = WALKED
) -> DataFrame:
    """One row per file below `root/<repository>/`, without content. `shares`: number of
    listing tasks, by default four per core of the session."""
    register(spark)
    staging = staging or Staging(spark)
    tasks = shares or 4 * spark.sparkContext.defaultParallelism
    frontier = spark.read.format(SOURCE_NAME).option("shares", str(tasks)).load(root).withColumn("path", F.lit(""))
    found = []
    while True:
        dealt = frontier.select("repo_id", "path").repartition(tasks, "repo_id", "path")
        step = dealt.mapInPandas(
            _expanded(root, walked), "repo_id string, path string, size_bytes bigint, location string, folder boolean"
        )
        step = staging.save(step, "listing").df
        found.append(step.filter(~F.col("folder")).drop("folder"))
        frontier = step.filter("folder")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write rows of the file contract as trees below a shared mount; lazily, as
    (repo_id, files) per task and repository. Rows without content are left out, a row
    written twice is the same file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        import pandas

        for batch in batches:
            written = batch[batch["content"].notna()]
            for row in written.itertuples(index=False):
                location = os.path.join(root, row.repo_id, row.path)
                os.makedirs(os.path.dirname(location), exist_ok=True)
                draft = f"{location}.{uuid.uuid4().hex}"
                with open(draft, "wb") as handle:
                    handle.write(row.content)
                os.replace(draft, location)
            if len(written):
                yield pandas.DataFrame(written.groupby("repo_id").size().rename("files").reset_index())

    return files.select("repo_id", "path", "content").mapInPandas(run, "repo_id string, files bigint")


def with_content(listing: DataFrame) -> DataFrame:
    """Add file bytes; an unreadable file has NULL content.

    Filter the listing first. Paths are spread again because top-level folders
    differ widely in size.
    """

    names = ["repo_id", "path", "size_bytes"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas

        def load(location):
            try:
                with open(location, "rb") as handle:
                    return handle.read()
            except OSError:
                return None

        def frame(rows):
            return pandas.DataFrame(rows, columns=[*names, "content"])

        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                content = load(row.location)
                rows.append((row.repo_id, row.path, row.size_bytes, content))
                held += len(content or b"")
                if held >= HELD_BYTES:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    spread = listing.repartition("repo_id", "path").select(*names, "location")
    return spread.mapInPandas(read, "repo_id string, path string, size_bytes bigint, content binary")
