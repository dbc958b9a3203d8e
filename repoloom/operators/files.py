"""Per-file facts: one pass over content, everything after it is compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import paths, text, tokens
from repoloom.operators import imports
from repoloom.settings import Settings


def counted(ext: Column, size_bytes: Column, settings: Settings) -> Column:
    """Does the file take part in token counts?"""
    return (
        ~ext.isin(*settings.denied_extensions)
        & ext.isin(*settings.counted_extensions)
        & size_bytes.between(1, settings.max_file_bytes)
    )


def with_path_features(files: DataFrame, settings: Settings) -> DataFrame:
    """Add directory, extension, language, and whether tokens are counted."""
    return files.withColumns(
        {
            "directory": paths.dir_name(F.col("path")),
            "extension": paths.extension(F.col("path")),
        }
    ).withColumns(
        {
            "language": paths.language(F.col("extension")),
            "counted": counted(F.col("extension"), F.col("size_bytes"), settings),
        }
    )


def unpruned(files: DataFrame, settings: Settings) -> DataFrame:
    """Drop files below a pruned directory."""
    return files.filter(~paths.in_pruned_directory(F.col("path"), settings.pruned_directories))


def relevant(files: DataFrame, settings: Settings) -> DataFrame:
    """Files that count tokens or enter the graph, chosen before content is touched."""
    return with_path_features(unpruned(files, settings), settings).filter(
        F.col("counted") | F.col("language").isNotNull()
    )


def with_text(files: DataFrame) -> DataFrame:
    """Replace bytes by text; `readable` is False where content is missing."""
    return files.withColumn("readable", F.col("content").isNotNull()).withColumn(
        "text", text.decode_lenient(F.col("content"))
    ).drop("content")


def with_tokens(files: DataFrame, settings: Settings) -> DataFrame:
    """Token count of counted, readable files; NULL elsewhere. `counter` names what counted
    them, since a token gate means something else under another counter."""
    counter = settings.token_counter or tokens.count_tokens
    counted = counter(F.when(F.col("counted"), F.col("text")))
    return files.withColumns({"tokens": counted, "counter": F.lit(settings.counter_name)})


def file_facts(files: DataFrame, settings: Settings) -> DataFrame:
    """Tokens and raw import targets per file; content is gone from the output.

    Both measurements share one scan. Only Python text crosses to Python workers.
    """
    measured = with_tokens(with_text(relevant(files, settings)), settings)
    return imports.with_imports(measured)
