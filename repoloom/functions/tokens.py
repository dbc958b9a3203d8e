"""Token counting and token lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, digit groups of up to three, and runs of other visible characters.
# No look-ahead, so that other SQL engines can evaluate the same pattern.
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def count_tokens(text: Column) -> Column:
    """Built-in counter: matches of the token pattern, inside the JVM.

    Every token becomes one character and white space goes, so the length is the
    count. That avoids building a list of all tokens just to measure it.
    """
    marks = F.regexp_replace(text, TOKEN_PATTERN, "x")
    return F.length(F.regexp_replace(marks, r"\s+", "")).cast("bigint")


def token_list(text: Column, max_length: int | None = None) -> Column:
    """Built-in tokens in order, cut to `max_length`."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return tokens if max_length is None else F.slice(tokens, 1, max_length)


def public_encoder(name: str = "cl100k_base") -> Callable[[], object]:
    """Loader of a public byte-pair encoder; executors need its rank file cached."""

    def load():
        import tiktoken

        return tiktoken.get_encoding(name)

    load.__name__ = name
    return load


def encoder_counter(load: Callable[[], object]) -> Callable[[Column], Column]:
    """Exact counter. The encoder is built once per Python worker, not per row."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            yield texts.map(
                lambda t: None if t is None else len(encoder.encode(t, disallowed_special=()))
            ).astype("Int64")

    count.__name__ = getattr(load, "__name__", "encoder")
    return count


def encoder_tokens(load: Callable[[], object], max_length: int) -> Callable[[Column], Column]:
    """Exact token ids, cut to `max_length`."""

    @F.pandas_udf("array<bigint>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            yield texts.map(
                lambda t: None
                if t is None
                else encoder.encode(t, disallowed_special=())[:max_length]
            )

    return encode
