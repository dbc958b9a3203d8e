"""Quality rules whose cutoffs follow the data.

Measures come from one pass over whole texts. Per language and source, each measure is
summarised in a mergeable quantile sketch: integer bins whose width doubles with the
value (relative error at most 1/32) and a count for each. Sketches of parts of the data
merge by adding counts, in any order and with the same result, so partial aggregation
does the merging and a hot source costs no more than its bins. Cutoffs are quartile
fences read from the sketches; the rows then meet the cutoffs of their group in a join.

Defined cases: a null or empty text has no words and fails the base rule; null languages
and sources form groups of their own; equal rows get equal verdicts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from repoloom.llm import textbytes
from repoloom.llm.tables import stage

MEASURES = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = 10


@dataclass(frozen=True)
class Rules:
    """`fence`: quartile ranges beyond the quartiles; `slack`: always allowed on top, in
    the unit of each measure (thousandths of a word, or of a character per word)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    fence: int = 3
    slack: tuple[tuple[str, int], ...] = (
        ("symbols", 30),
        ("word_length", 500),
        ("dup_lines", 60),
        ("repeats", 100),
    )


def _per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of texts data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    words = textbytes.find_words(data, offsets, textbytes.SPACE_WORDS)
    doc = words.doc
    begins_char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = begins_char[words.ends] - begins_char[words.starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_doc(doc, n, chars),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _dup_lines(data, offsets, words),
        "n_repeat_words": _repeat_words(words, doc, n),
    }


def _within(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same text."""
    return textbytes.mix(hashes ^ textbytes.mix(doc.astype(np.uint64), 5), 6)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, words: textbytes.Words) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == _NEWLINE)
    # A line starts with each text and after each break; a break belongs to the text it lies in.
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    ends = np.where(last, offsets[doc + 1], np.append(starts[1:], 0)[: len(starts)] - 1)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    keys = _within(doc, textbytes.span_hashes(data, starts, ends))
    _, kept = np.unique(keys, return_index=True)
    return _per_doc(doc, n) - _per_doc(doc[kept], n)


def _repeat_words(words: textbytes.Words, doc: np.ndarray, n: int) -> np.ndarray:
    windows = textbytes.shingle_hashes(words.hashes(), 3)
    if not len(windows):
        return np.zeros(n, dtype=np.int64)
    inside = np.flatnonzero(doc[: len(windows)] == doc[2:])
    keys = _within(doc[inside], windows[inside])
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    starts = inside[times[which] > 1]
    covered = np.zeros(len(doc), dtype=bool)
    for k in range(3):
        covered[starts + k] = True
    return _per_doc(doc[covered], n)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in textbytes.slices(batch, "text"):
            found = measure(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), part.column("source")]
                + [pa.array(found[name]) for name in _ARROW.names[3:]],
                schema=_ARROW,
            )


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of every whole text, with its group."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    return rows.mapInArrow(_measure_batches, MEASURES)


def _ratios() -> dict[str, Column]:
    """The judged measures, as whole thousandths."""
    return {
        "symbols": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
        "word_length": F.expr("word_chars * 1000 div greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_words, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
    }


def bin_of(value: Column) -> Column:
    """The sketch bin of a non-negative whole number, named by its smallest member: the six
    leading bits are kept."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): mergeable by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(v).alias("bin")) for k, v in _ratios().items()]))
    return (
        rows.filter("n_words > 0")
        .select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cutoffs(sketch: DataFrame, rules: Rules) -> DataFrame:
    """One row per group: `<measure>_low` and `<measure>_high`."""
    group = W.partitionBy("lang", "source", "measure")
    ranked = sketch.select(
        "*",
        F.sum("n").over(group.orderBy("bin")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
    fences = ranked.groupBy("lang", "source", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = reduce(lambda c, kv: c.when(F.col("measure") == kv[0], F.lit(kv[1])), rules.slack, F.when(F.lit(False), F.lit(0)))
    reach = (F.col("q3") - F.col("q1")) * rules.fence + slack
    fences = fences.select("lang", "source", "measure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    return fences.groupBy("lang", "source").agg(
        *[
            F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}")
            for name, _ in rules.slack
            for side in ("low", "high")
        ]
    )


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    rows = stage(measures(docs), "measures")
    fences = cutoffs(sketches(rows), rules)
    fences = fences.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *fences.columns[2:])
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    within = reduce(
        lambda a, b: a & b,
        [value.between(F.col(f"{name}_low"), F.col(f"{name}_high")) for name, value in _ratios().items()],
    )
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    return rows.join(fences, same, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(within, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that pass, all columns kept."""
    good = judge(docs, rules).filter("kept").select(F.col("doc_id").alias("__kept_id"))
    return docs.join(good, docs["doc_id"] == good["__kept_id"], "left_semi")
