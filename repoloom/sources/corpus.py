"""Training text: JSON records, JSON lines, or one document per text line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Column `text`. `.txt` is read by line, any other suffix as JSON.

    `array_file` reads documents that are one JSON array; such a file cannot be
    split, so it is meant for small inputs. A malformed record fails the read, and
    so does one without a text.
    """
    if path.rstrip("/").endswith(".txt"):
        return spark.read.text(path).select(F.col("value").alias("text"))
    records = spark.read.schema("text string").option("multiLine", array_file).option("mode", "FAILFAST").json(path)
    missing = F.raise_error(F.lit("a record of the corpus has no text"))
    return records.select(F.coalesce("text", missing.cast("string")).alias("text"))


def export_corpus(files: DataFrame, path: str) -> None:
    """Write file texts as JSON lines with the one field `text`, a row per file."""
    files.select("text").write.option("ignoreNullFields", "false").json(path)
