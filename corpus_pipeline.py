"""Cleaning and packing of a corpus: stages of the operators in `repoloom.llm`.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of `documents`.

1. Quality classifier: documents that importance resampling doesn't draw go.
2. Line deduplication: lines that occurred before (up to two edits) go from the texts.
3. MinHash near-duplicates: one document of each group stays, the one with the smallest id.
4. Benchmark decontamination: documents with a passage of the benchmark go.
5. Best-fit packing: token pieces with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repoloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_classifier
from repoloom.llm.queries import tokenizer_path
from repoloom.llm.tables import read, stage


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier draws."""
    return quality_classifier.keep_selected(docs, read(spark, sf_dir, "labels"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before."""
    return line_dedup.keep_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more)."""
    return near_dedup.keep_first(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents, with its place in a sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", deduplicate_lines),
    ("near dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack_sequences),
]

# The classifier, the tree search and the packing have no SQL form; tests/llm compares
# each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
