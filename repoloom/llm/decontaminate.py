"""Benchmark decontamination with Aho-Corasick automata.

Items and texts are normalised alike: A-Z lowered, every run of other characters than
letters and digits one space. All windows of all items go into one automaton, and each
text is scanned once; hits are mapped back to words and to byte offsets of the original.

The automaton is sent to the tasks, so its size is bounded: items are taken in blocks of
about `block_bytes` of text, of which the driver holds one at a time. A benchmark is far
below one block. Of a larger one, each further block is a scan of its own whose few hits
are written down by the text's digest; they meet the rows of the first scan there, so the
result has one row per row of documents whatever the number of blocks.

Defined cases: null or empty texts and items have no words and no hits; an item of fewer
words than a window is one window; items that repeat the same text are all reported, an
item id that occurs twice is reported once; a window inside a window counts for both; rows
with a null id or an id that repeats are judged each by its own text; items without an id
are left out; other columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import textbytes
from repoloom.llm.tables import fresh, ids_and_texts, stage

WINDOW = 10
BLOCK_BYTES = 8 << 20

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, hit_spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("digest", pa.string()),
        ("n_words", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("word_runs", _RUNS),
        ("hit_spans", _SPAN),
    ]
)
_SCAN = "doc_id long, digest string, n_words long, items array<string>, word_runs array<struct<start:long,end:long>>, hit_spans array<struct<start:long,end:long>>"


def item_windows(texts: list[str | None], width: int) -> dict[str, list[int]]:
    """Normalised window -> indexes of the items that have it. Each window is ' w1 w2 .. '."""
    found: dict[str, list[int]] = {}
    for index, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        clean, words = normalise(data, np.array([0, len(data)]))
        tokens = clean.split()
        if not tokens:
            continue
        last = max(len(tokens) - width, 0)
        for window in {" ".join(tokens[i : i + width]) for i in range(last + 1)}:
            found.setdefault(f" {window} ", []).append(index)
    return found


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[str, textbytes.Words]:
    """The words of all texts, one space apart and two at the border of texts, one
    character per byte (so that places are byte places), with their original places."""
    low = textbytes.lowered(data)
    words = textbytes.find_words(low, offsets, textbytes.ALNUM_WORDS)
    lengths = words.ends - words.starts
    border = np.zeros(len(lengths), dtype=np.int64)
    begins = words.first[:-1][words.counts > 0]
    border[begins] = 1
    places = np.cumsum(lengths + 1 + border) - lengths  # where each word starts
    clean = np.full(int(places[-1] + lengths[-1] + 1) if len(places) else 1, 32, dtype=np.uint8)
    index = np.repeat(places - words.starts, lengths) + textbytes.ranges(words.starts, lengths)
    clean[index] = low[textbytes.ranges(words.starts, lengths)]
    words.places = places
    return clean.tobytes().decode("latin-1"), words


class Scanner:
    """One automaton over all windows of a block of items."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        import ahocorasick

        self.ids = ids
        self.items: list[list[int]] = []
        self.automaton = ahocorasick.Automaton()
        for window, items in item_windows(texts, width).items():
            self.automaton.add_word(window, (len(self.items), window.count(" ") - 1))
            self.items.append(items)
        if self.items:
            self.automaton.make_automaton()

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: number of words, item ids, hit word runs, hit byte spans."""
        clean, words = normalise(data, offsets)
        n = len(offsets) - 1
        items: list[set] = [set() for _ in range(n)]
        runs: list[list] = [[] for _ in range(n)]
        spans: list[list] = [[] for _ in range(n)]
        hits = list(self.automaton.iter(clean)) if self.items else []
        if hits:
            # A hit ends on the space after its last word.
            ends = np.array([at for at, _ in hits])
            last = np.searchsorted(words.places, ends) - 1
            size = np.array([k for _, (_, k) in hits])
            begin = last - size + 1
            doc = np.searchsorted(words.first, begin, side="right") - 1
            for d, (_, (window, _)) in zip(doc.tolist(), hits):
                items[d].add(window)
            cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, last + 1, -1)
            hit = np.cumsum(cover[:-1]) > 0
            owner = words.doc
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                # A run may pass from one text into the next.
                while a < b:
                    d = int(owner[a])
                    stop = min(b, int(words.first[d + 1]))
                    runs[d].append((a - int(words.first[d]), stop - int(words.first[d])))
                    spans[d].append((int(words.starts[a] - offsets[d]), int(words.ends[stop - 1] - offsets[d])))
                    a = stop
        named = [sorted({self.ids[i] for w in s for i in self.items[w]}) for s in items]
        return words.counts, named, runs, spans


_scanners: dict[tuple, Scanner] = {}


def _scan_with(shared, width: int):
    """The scan of a batch; the automaton is built once per Python worker and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ids, texts = shared.value
        if (token, width) not in _scanners:
            _scanners.clear()
            _scanners[token, width] = Scanner(ids, texts, width)
        scanner = _scanners[token, width]
        as_structs = lambda lists: [[{"start": a, "end": b} for a, b in x] for x in lists]
        for batch in batches:
            for part, data, offsets in textbytes.slices(batch, "text"):
                counts, items, runs, spans = scanner.scan(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("digest"),
                        pa.array(counts, pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(as_structs(runs), _RUNS),
                        pa.array(as_structs(spans), _SPAN),
                    ],
                    schema=_ARROW,
                )

    return run


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Item rows in blocks of at most about `block_bytes` of text each."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // block_bytes) or 1
    if n == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def _scan_block(texts: DataFrame, block: DataFrame, width: int) -> tuple[DataFrame, Broadcast]:
    """Hits of one block in every row of texts, and what the tasks hold for it."""
    rows = block.orderBy("item_id", "text").collect()
    token = hashlib.sha256(repr([tuple(r) for r in rows]).encode()).hexdigest()
    shared = texts.sparkSession.sparkContext.broadcast((token, [r["item_id"] for r in rows], [r["text"] for r in rows]))
    return texts.mapInArrow(_scan_with(shared, width), _SCAN), shared


def _scan_texts(texts: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """Hits in every row (doc_id, digest, text). Digests may be null in a scan of one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    first, *others = _blocks(items.filter("item_id is not null and text is not null"), block_bytes)
    if not others:
        return _scan_block(texts, first, width)[0]
    texts = texts.withColumn("digest", F.sha2("text", 256))
    parts = []
    for k, block in enumerate([first, *others]):
        found, shared = _scan_block(texts, block, width)
        # Equal texts have equal hits.
        few = found.filter(F.size("items") > 0).drop("doc_id", "n_words").dropDuplicates(["digest"])
        parts.append(stage(few if k else found, "block"))
        shared.destroy()
    merged = reduce(DataFrame.unionByName, parts[1:])
    lists = ("items", "word_runs", "hit_spans")
    merged = merged.groupBy("digest").agg(*[F.flatten(F.collect_list(name)).alias(f"more_{name}") for name in lists])
    both = [F.concat(F.col(name), F.coalesce(f"more_{name}", F.array())).alias(name) for name in lists]
    joined = parts[0].join(merged, "digest", "left").select("doc_id", "digest", "n_words", *both)
    return joined.withColumn("items", F.array_sort(F.array_distinct("items")))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, items, word_runs (hit words, end exclusive), hit_spans (bytes of
    the original text): one row per row of `docs`."""
    texts = ids_and_texts(docs).withColumn("digest", F.lit(None).cast("string"))
    return _scan_texts(texts, benchmark, width, block_bytes).drop("digest")


def _n_hit():
    """Words in the union of runs, which may overlap where blocks were merged."""
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["end"] - F.greatest(r["start"], acc["upto"]), F.lit(0))).alias("n"),
        F.greatest(acc["upto"], r["end"]).alias("upto"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(F.array_sort("word_runs"), zero, step, lambda acc: acc["n"])


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_spans."""
    return scan(docs, benchmark, width, block_bytes).select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "items",
        "hit_spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` without any window of the benchmark, all columns kept. Rows are
    known by the digest of their text, which alone decides."""
    texts = ids_and_texts(docs).withColumn("digest", F.sha2("text", 256))
    name = fresh(docs, "bad_digest")
    found = _scan_texts(texts, benchmark, width, block_bytes).filter(F.size("items") > 0)
    bad = found.select(F.col("digest").alias(name)).distinct()
    return docs.join(bad, F.sha2(docs["text"].cast("string"), 256) == bad[name], "left_anti")
