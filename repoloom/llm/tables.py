"""Shared pieces of the operators: inputs, staging, and frames made inside tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.operators.prefilter import likely_in
from repoloom.sources.staging import Staging

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator uses, under fixed names, so that other columns of any
    name cannot clash with its own."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there."""
    path = Staging(df.sparkSession).path(name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def members_only(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of `rows` with `wanted` on `keys`, for wide rows of which few are wanted:
    hardly any others are shuffled."""
    return likely_in(rows, wanted, keys).join(wanted, keys)
