"""Quality selection by importance resampling.

Two hashed n-gram models are counted: one of the target (documents labelled good, at most
`max_labelled` of them), one of the raw text (all documents). N-grams are lower-case words,
and single and paired word shapes (capitals, digits, punctuation that follows, whether the
word repeats the one before). An n-gram counts once per document. Words are hashed twice;
the milder of the two ratios holds, so that a clean word which shares one bucket with a
telling one does no harm.

The log weight of a document is the sum of log(target share / raw share) over the n-grams
which the target has clearly too rarely (ratio below `ratio`); common n-grams carry no
information and count as 0, whatever the length of the text. `sharpness` multiplies the sum,
so that little noise is left between clean and doubtful documents. A weight is at most 1,
and the sum of weights is the number of documents that the target accounts for. That many are
drawn without replacement, each by its weight: log weight plus Gumbel noise (fixed by the
document's id), the largest k of all.

Only the two count tables (a fixed number of buckets) and histograms of the noisy weights
reach the driver. Defined cases: null or empty texts have no n-grams and weight 1; without
labelled documents all weights are 1; rows that tie at the last place are all kept; rows
that repeat an id get the same noise; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import textbytes
from repoloom.llm.tables import ids_and_texts, stage

WORD_BUCKETS = 1 << 17
SHAPE_BUCKETS = 1 << 16
BUCKETS = 2 * WORD_BUCKETS + SHAPE_BUCKETS
MAX_LABELLED = 20_000
RATIO = 0.25
SHARPNESS = 4.0
PRIOR = 3.0
BINS = 1024
UNIT = 1_000_000

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, dtype=np.int64)
_SMALL[97:123] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_CORE = textbytes.ALNUM_WORDS.copy()
_CORE[65:91] = True


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[ends] - sums[starts]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first bucket, second bucket) of the distinct n-grams of all texts; shapes have
    one bucket, given twice."""
    low = textbytes.lowered(data)
    cores = textbytes.find_words(low, offsets, textbytes.ALNUM_WORDS)
    word = cores.hashes()
    n_word = np.uint64(WORD_BUCKETS)
    rows = [(cores.doc, (textbytes.mix(word, 701) % n_word).astype(np.int64), (textbytes.mix(word, 702) % n_word).astype(np.int64) + WORD_BUCKETS)]

    spaced = textbytes.find_words(data, offsets, textbytes.SPACE_WORDS)
    doc, starts, ends = spaced.doc, spaced.starts, spaced.ends
    # The last letter or digit of each word; what follows is its punctuation.
    last_core = np.maximum.accumulate(np.where(_CORE[data], np.arange(len(data)), -1)) if len(data) else np.empty(0, np.int64)
    tail = np.maximum(last_core[ends - 1] + 1, starts) if len(ends) else ends
    punctuation = textbytes.span_hashes(data, tail, ends)
    upper, small = _count(_UPPER[data], starts, ends), _count(_SMALL[data], starts, ends)
    case = np.where(upper == 0, 0, np.where((small == 0) & (upper > 1), 2, 1))
    digits = _count(_DIGIT[data], starts, ends) > 0
    whole = textbytes.span_hashes(low, starts, ends)
    repeats = np.zeros(len(whole), dtype=bool)
    repeats[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    code = (case + 3 * digits + 6 * repeats).astype(np.uint64)
    with np.errstate(over="ignore"):
        shape = textbytes.mix(punctuation + code * np.uint64(0x9E3779B97F4A7C15), 703)
    n_shape, base = np.uint64(SHAPE_BUCKETS), 2 * WORD_BUCKETS
    pairs = textbytes.shingle_hashes(shape, 2)
    inside = np.flatnonzero(doc[: len(pairs)] == doc[1:]) if len(pairs) else np.empty(0, np.int64)
    for owner, value in ((doc, shape), (doc[inside], pairs[inside])):
        bucket = (value % n_shape).astype(np.int64) + base
        rows.append((owner, bucket, bucket))

    owner, one, two = (np.concatenate(x) for x in zip(*rows))
    key = (owner << 20) | one  # 2^19 buckets at most
    _, at = np.unique(key, return_index=True)
    return owner[at], one[at], two[at]


_COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket: all, and those of the target; one table per task."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for part, data, offsets in textbytes.slices(batch, "text"):
            owner, one, two = features(data, offsets)
            good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)[owner]
            second = two != one
            for k, use in ((0, slice(None)), (1, good)):
                counts[k] += np.bincount(one[use], minlength=BUCKETS)
            counts[0] += np.bincount(two[second], minlength=BUCKETS)
            counts[1] += np.bincount(two[second & good], minlength=BUCKETS)
    seen = np.flatnonzero(counts[0])
    if len(seen):
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], schema=_COUNTS
        )


def ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int, ratio: float) -> np.ndarray:
    """Per bucket log(target share / raw share) where that is below log(ratio), else 0."""
    if not n_target or not n_raw:
        return np.zeros(len(raw))
    expected = raw * (n_target / n_raw)
    found = np.log((target + PRIOR) / (expected + PRIOR))
    return np.where(found < np.log(ratio), found, 0.0)


_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64())])


def _weight_batches(shared, sharpness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part, data, offsets in textbytes.slices(batch, "text"):
                owner, one, two = features(data, offsets)
                milder = np.maximum(table[one], table[two])
                total = np.bincount(owner, weights=milder, minlength=part.num_rows) * sharpness
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total)], schema=_WEIGHTS)

    return run


def good_labels(labels: DataFrame, max_labelled: int) -> DataFrame:
    """Ids of documents labelled good, at most `max_labelled` of them, those of the smallest
    hash."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    return good.orderBy(F.xxhash64("good_id"), "good_id").limit(max_labelled)


def log_weights(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, ratio: float = RATIO, sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, log_weight) of every document."""
    texts = ids_and_texts(docs)
    # At most max_labelled ids of 8 bytes, hence the broadcast.
    good = F.broadcast(good_labels(labels, max_labelled))
    marked = texts.join(good, texts["doc_id"] == good["good_id"], "left").select("text", F.col("good_id").isNotNull().alias("good"))
    sizes = marked.agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("good"), 1)).alias("target")).first()
    counts = marked.mapInArrow(_count_batches, "bucket int, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"].to_numpy()] = counts["raw"].to_numpy()
    target[counts["bucket"].to_numpy()] = counts["target"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(ratios(raw, target, sizes["raw"], sizes["target"], ratio))
    return texts.mapInArrow(_weight_batches(shared, sharpness), "doc_id long, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of whole numbers, by histograms of `BINS` bins over a
    range that shrinks to one number."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None or k <= 0:
        return None
    while low < high:
        width = -(-(high - low + 1) // BINS)
        place = F.floor((F.col(column) - F.lit(low)) / F.lit(width))
        bins = rows.filter(F.col(column).between(low, high)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        counts = sorted(((r["bin"], r["n"]) for r in bins.collect()), reverse=True)
        for place, n in counts:
            if n >= k:
                break
            k -= n
        else:
            return low
        low, high = low + place * width, min(high, low + (place + 1) * width - 1)
    return low


def select(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, ratio: float = RATIO) -> DataFrame:
    """doc_id, log_weight, noisy_weight (in millionths), kept."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gumbel = -F.log(-F.log(uniform))
    noisy = F.round((F.col("log_weight") + gumbel) * UNIT).cast("long")
    rows = stage(log_weights(docs, labels, max_labelled, ratio).withColumn("noisy_weight", noisy), "weights")
    k = rows.agg(F.sum(F.exp("log_weight")).alias("k")).first()["k"]
    least = kth_largest(rows, "noisy_weight", round(k or 0))
    kept = F.lit(False) if least is None else F.col("noisy_weight") >= least
    return rows.withColumn("kept", kept)


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are drawn; rows with a null id or text all stay."""
    gone = select(docs, labels).filter("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
