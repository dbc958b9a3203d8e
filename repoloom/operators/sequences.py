"""Training sequences from a text corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import tokens
from repoloom.settings import MAX_SEQUENCE_TOKENS


def tokenize(
    corpus: DataFrame,
    max_length: int = MAX_SEQUENCE_TOKENS,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row out per row in, holding only the token columns; no padding.

    `tokenizer` may be `functions.tokens.encoder_tokens(...)` for exact ids; the
    built-in tokens are the matched strings.
    """
    text = F.col("text")
    ids = tokenizer(text) if tokenizer else tokens.token_list(text, max_length)
    return corpus.select(F.slice(ids, 1, max_length).alias("input_ids")).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))
    )


def corpus_size(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("examples"))
