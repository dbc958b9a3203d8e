"""Intermediate tables on the shared checkpoint folder.

Writing a table cuts lineage, survives lost executors, and gives the planner
real sizes for the next join.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by the session; a local session without one gets its own, which
    goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="repoloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Staging:
    """A private folder of staged tables below the checkpoint root."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/staged-{uuid.uuid4().hex}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:04d}-{name}"

    def save(self, df: DataFrame, name: str) -> "StagedTable":
        """Write `df` once; its row count comes along with the same job."""
        path = self.path(name)
        seen = Observation(f"{name}-{self._made}-{uuid.uuid4().hex[:8]}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        rows = seen.get["rows"]
        return StagedTable(self, self.spark.read.schema(df.schema).parquet(path), path, rows)

    def close(self) -> None:
        """Delete the whole folder; frames read from it are unusable afterwards."""
        delete_path(self.spark, self.root)


class StagedTable:
    def __init__(self, staging: Staging, df: DataFrame, path: str, rows: int):
        self.staging = staging
        self.df = df
        self.path = path
        self.rows = rows

    def drop(self) -> None:
        delete_path(self.staging.spark, self.path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete through the cluster's file system client, wherever the path lives."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
