"""Long repeated passages, removed with FM-indexes over shards of the corpus.

A window is `width` consecutive words; a word goes if a window over it also starts in a
document with a smaller id. Which texts can share a window is settled by content, so that
each text meets one shard and not all: the minimizer of a window is the smallest hash of
its 8-word runs, and equal windows have equal minimizers. Consecutive windows with one
minimizer make a segment. Segments whose minimizer occurs in one document only are done;
the others are merged where their words are equal (a group of copies becomes one segment)
and dealt to shards by minimizer. Each shard builds an FM-index of its segments, streams
them through it by backward search, and reports the runs of windows with the smallest
document that has them. Every document then meets the reports on its own segments.

A minimizer with more than `max_segments` different segments is cut into single windows
first, of which those of one document go: what many documents share is then one segment
each. Equal windows have equal content, so these are dealt by content too. Shards are sized
by their words; the most that stays together is one minimizer's `max_segments` segments.

Defined cases: null or empty texts have no words; rows that share an id are one document,
whatever their texts: each loses what a smaller id has, nothing for the sake of another
(inside, rows are known by id and a hash of the text); rows with a null id keep all words;
texts below `width` words lose nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import textbytes
from repoloom.llm.fm_index import FmIndex
from repoloom.llm.tables import ids_and_texts, stage

WIDTH = 50
RUN = 8
LONGEST = 64
SHARD_WORDS = 400_000
MAX_SEGMENTS = 20_000

_SEGMENTS = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("minimizer", pa.int64()), ("content", pa.int64())]
)
_SEGMENTS_DDL = "doc_id long, key long, start int, windows int, minimizer long, content long"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    have, reach = values, 1
    while reach * 2 <= width:
        have = np.minimum(have[:-reach], have[reach:])
        reach *= 2
    return have if reach == width else np.minimum(have[: len(values) - width + 1], have[width - reach :])


def segments(words: textbytes.Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, windows, minimizer, content hash) of all segments."""
    none = np.empty(0, dtype=np.int64)
    n = len(hashes) - width + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    run = min(RUN, width)
    least = _sliding_min(textbytes.shingle_hashes(hashes, run), width - run + 1)
    doc = words.doc
    valid = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    change = np.append(True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]))
    begin = np.flatnonzero(change)
    # Long runs (of repeated words) are cut, from their start on.
    within = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(change | (within % LONGEST == 0))
    windows = np.diff(np.append(begin, len(at)))
    first = at[begin]
    content = textbytes.sequence_hashes(hashes, first, first + windows + width - 1)
    return doc[first], first - words.first[doc[first]], windows, least[first], content


def _segment_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.slices(batch, "text"):
                words = textbytes.find_words(data, offsets, textbytes.SPACE_WORDS)
                doc, start, windows, minimizer, content = segments(words, words.hashes(), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        part.column("key").take(pa.array(doc)),
                        pa.array(start.astype(np.int32)),
                        pa.array(windows.astype(np.int32)),
                        pa.array(minimizer.view(np.int64)),
                        pa.array(content.view(np.int64)),
                    ],
                    schema=_SEGMENTS,
                )

    return run


def _chosen(batches: Iterator[pa.RecordBatch]):
    """(id, key, wanted segments, word hashes) of rows (doc_id, key, text, wanted)."""
    for whole in batches:
        for batch, data, offsets in textbytes.slices(whole, "text"):
            words = textbytes.find_words(data, offsets, textbytes.SPACE_WORDS)
            hashes = words.hashes()
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                yield batch.column("doc_id")[i].as_py(), batch.column("key")[i].as_py(), wanted, hashes[words.first[i] : words.first[i + 1]]


def _single_windows(width: int):
    """Wanted segments as one row per window."""

    def run(batches):
        for doc_id, key, wanted, hashes in _chosen(batches):
            for w in wanted:
                start = np.arange(w["start"], w["start"] + w["windows"])
                content = textbytes.sequence_hashes(hashes, start, start + width)
                one = np.ones(len(start), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(start), doc_id, dtype=np.int64)),
                        pa.array(np.full(len(start), key, dtype=np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(one),
                        pa.array(np.full(len(start), w["minimizer"], dtype=np.int64)),
                        pa.array(content.view(np.int64)),
                    ],
                    schema=_SEGMENTS,
                )

    return run


_FETCHED = pa.schema(
    [("shard", pa.int64()), ("minimizer", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.binary())]
)
_FETCHED_DDL = "shard long, minimizer long, content long, first long, last long, words binary"


def _fetch(width: int):
    """Wanted segments with their words (as hashes)."""

    def run(batches):
        for doc_id, _, wanted, hashes in _chosen(batches):
            rows = [
                (w["shard"], w["minimizer"], w["content"], doc_id, w["last"], hashes[w["start"] : w["start"] + w["windows"] + width - 1].tobytes())
                for w in wanted
            ]
            columns = [pa.array(values, _FETCHED.field(k).type) for k, values in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays(columns, schema=_FETCHED)

    return run


_RUNS = pa.list_(pa.struct([("at", pa.int32()), ("windows", pa.int32()), ("least", pa.int64())]))
_REPORTS = pa.schema([("minimizer", pa.int64()), ("content", pa.int64()), ("runs", _RUNS)])
_REPORTS_DDL = "minimizer long, content long, runs array<struct<at:int,windows:int,least:long>>"


def _search_shard(width: int):
    """Index a shard's segments and stream them through the index."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(w, dtype=np.uint64) for w in table.column("words").to_pylist()]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        first = table.column("first").to_numpy()
        least = FmIndex(words, lengths, first, width).stream(words, lengths)
        last = table.column("last").to_numpy()
        begins = np.cumsum(lengths) - lengths
        reports = []
        for begin, length, newest in zip(begins, lengths, last):
            own = least[begin : begin + length - width + 1]
            edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(edges, len(own)))
            # Of use to documents that are newer than the oldest owner.
            reports.append(
                [
                    {"at": int(a), "windows": int(n), "least": int(own[a])}
                    for a, n in zip(edges, sizes)
                    if own[a] < newest
                ]
            )
        return pa.Table.from_arrays(
            [table.column("minimizer").combine_chunks(), table.column("content").combine_chunks(), pa.array(reports, _RUNS)],
            schema=_REPORTS,
        )

    return run


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept_text", pa.string()),
    ]
)


def _remove(width: int, with_text: bool):
    schema = _RESULT if with_text else pa.schema(list(_RESULT)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in textbytes.slices(whole, "text"):
                raw = data.tobytes()
                counts, removed, digests, texts = [], [], [], []
                for i, runs in enumerate(batch.column("runs").to_pylist()):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    gone = 0
                    if runs:
                        cover = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(cover, [r["at"] for r in runs], 1)
                        np.add.at(cover, [r["at"] + r["windows"] + width - 1 for r in runs], -1)
                        covered = np.cumsum(cover[:-1]) > 0
                        gone = int(covered.sum())
                        kept = b" ".join(w for w, c in zip(words, covered.tolist()) if not c)
                    else:
                        kept = b" ".join(words)
                    counts.append(len(words))
                    removed.append(gone)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if with_text else None)
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, schema=schema)

    return run


def _with_wanted(texts: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """Texts with the list of their wanted segments, which is bounded by the text; rows that
    repeat id and text are one."""
    fields = F.struct("start", "windows", "minimizer", "content", *more)
    wanted = rows.groupBy("doc_id", "key").agg(F.collect_set(fields).alias("wanted"))
    return texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])


def _cut_hot(shared: DataFrame, texts: DataFrame, width: int, max_segments: int) -> DataFrame:
    """Segments of very frequent minimizers as single windows."""
    kinds = shared.groupBy("minimizer", "content").agg(F.first("windows").alias("windows"))
    hot = kinds.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_segments)
    hot = stage(hot.select("minimizer"), "hot")
    if hot.isEmpty():
        return shared.withColumn("cut", F.lit(False))
    cut = shared.join(hot, "minimizer", "left_semi")
    single = _with_wanted(texts, cut).mapInArrow(_single_windows(width), _SEGMENTS_DDL)
    rest = shared.join(hot, "minimizer", "left_anti").withColumn("cut", F.lit(False))
    return stage(rest.unionByName(single.withColumn("cut", F.lit(True))), "shared")


def remove_repeats(
    docs: DataFrame,
    width: int = WIDTH,
    with_text: bool = False,
    shard_words: int = SHARD_WORDS,
    max_segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space apart); with
    `with_text` also those words as kept_text."""
    texts = ids_and_texts(docs).withColumn("key", F.xxhash64("text"))
    rows = stage(texts.filter("doc_id is not null").mapInArrow(_segment_batches(width), _SEGMENTS_DDL), "segments")
    spread = rows.groupBy("minimizer").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = stage(rows.join(spread.filter("first < last").select("minimizer"), "minimizer", "left_semi"), "shared")
    shared = _cut_hot(shared.select(_SEGMENTS.names), texts, width, max_segments)
    kinds = shared.groupBy("minimizer", "content").agg(
        F.min(F.struct("doc_id", "key", "start", "windows")).alias("f"), F.max("doc_id").alias("last"), F.first("cut").alias("cut")
    )
    # Where all segments are single windows, one that only one document has has no like.
    kinds = stage(
        kinds.filter("not cut or f.doc_id < last").select(
            "minimizer", "content", "last", "cut", "f.doc_id", "f.key", "f.start", "f.windows"
        ),
        "kinds",
    )
    size = kinds.agg(F.coalesce(F.sum(F.col("windows") + (width - 1)), F.lit(0)).alias("n")).first()["n"]
    shards = -(-size // shard_words) or 1
    dealt = F.when(F.col("cut"), F.xxhash64("minimizer", "content")).otherwise(F.xxhash64("minimizer"))
    kinds = kinds.withColumn("shard", F.pmod(dealt, F.lit(shards)))
    fetched = _with_wanted(texts, kinds, "last", "shard").mapInArrow(_fetch(width), _FETCHED_DDL)
    reports = fetched.groupBy("shard").applyInArrow(_search_shard(width), _REPORTS_DDL)
    reports = stage(reports.filter(F.size("runs") > 0), "reports")
    runs = (
        shared.join(reports, ["minimizer", "content"])
        .select("doc_id", "key", "start", F.explode("runs").alias("r"))
        .filter(F.col("r.least") < F.col("doc_id"))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("r.at")).alias("at"), F.col("r.windows").alias("windows"))).alias("runs"))
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(runs, ["doc_id", "key"], "left").mapInArrow(_remove(width, with_text), schema)
