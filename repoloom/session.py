"""Session settings that this library expects; a cluster session may bring its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cores: str = "8", app: str = "repoloom", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    inherited = os.environ.get("PYTHONPATH")
    os.environ["PYTHONPATH"] = root if not inherited else f"{root}{os.pathsep}{inherited}"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs several milliseconds per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
