"""Byte-level BPE: whole texts to token ids and back.

A text is cut into chunks of `chunk` characters, each with `overlap` characters of its
successor, and every chunk is split into pre-tokens from its own first character, in parallel
and not knowing where the pre-tokens of the text begin. A match depends on nothing before it,
so two chunks that share one boundary agree from there on: the first boundary that both have
in their overlap is where one hands over to the next. The pieces between such boundaries are
then encoded in parallel. Decoding looks up each id's bytes and concatenates them.

A chunk without a shared boundary (a pre-token longer than the overlap lies over its border)
cannot start anywhere safely. It and all later chunks of its text are joined to the last safe
chunk and split from there, so the ids are those of the whole text in any case.

The pattern must match every character, look at nothing before a match and at no more than
`MARGIN` characters after it.

Parameters: the rank file (lines of base64 token and rank), the pattern, `chunk` and `overlap`.

Defined results. Null and empty texts have no ids. Rows stay apart whatever their id: repeated
and null ids give one row each. Columns other than id and text are not used, so their names
can't clash. An empty table gives an empty table. An unknown id fails in decoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoloom.llm.tables import ids_and_texts, stage
from repoloom.llm.textbytes import ranges, slices

CHUNK = 1 << 14
OVERLAP = 1 << 10
MARGIN = 8
# Encoded pieces kept per Python worker.
CACHE = 1 << 18


class Known(dict):
    """Ids of the pieces seen so far; others are encoded when asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        ids = self[piece] = tuple(self.encode(piece))
        return ids

    def all(self, pieces: list[str]) -> np.ndarray:
        """The ids of all pieces, one after the other."""
        return np.fromiter(chain.from_iterable(map(self.__getitem__, pieces)), dtype=np.int32)


def merger(ranks: dict[bytes, int]):
    """A function from one piece, whole, to its ids by these ranks."""
    return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ByteBpe:
    """Ids of pieces by a rank file, and the bytes of ids."""

    def __init__(self, rank_file: str):
        ranks: dict[bytes, int] = {}
        with open(rank_file, "rb") as lines:
            for line in lines:
                token, _, rank = line.strip().partition(b" ")
                if token:
                    ranks[base64.b64decode(token)] = int(rank)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known = Known(merger(ranks))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("unknown token id")
        return self.bytes[ranges(self.places[ids], self.sizes[ids])]


_loaded: dict[str, ByteBpe] = {}


def load(rank_file: str) -> ByteBpe:
    """One table per Python worker."""
    if rank_file not in _loaded:
        _loaded[rank_file] = ByteBpe(rank_file)
    return _loaded[rank_file]


# --- Chunks ------------------------------------------------------------------------

_CHUNKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])
_CHUNKS_DDL = "row long, doc_id long, i int, last boolean, part string"


def _cut(chunk: int, overlap: int):
    """Chunks of whole texts, each with the characters that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch.column("row"), batch.column("doc_id"), batch.column("text")):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    parts = [text[s : s + chunk + overlap + MARGIN] for s in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.as_py()] * len(some), pa.int64()),
                            pa.array([doc.as_py()] * len(some), pa.int64()),
                            pa.array([s // chunk for s in some], pa.int32()),
                            pa.array([s + chunk >= len(text) for s in some]),
                            pa.array(parts, pa.string()),
                        ],
                        schema=_CHUNKS,
                    )

    return run


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Where pre-tokens begin if the first one begins at 0, as far as what follows `text`
    cannot change it; `last`: nothing follows."""
    safe = len(text) if last else len(text) - MARGIN
    found = [0]
    for match in pattern.finditer(text):
        if match.end() > safe:
            break
        found.append(match.end())
    return found


def _split(pattern: str, chunk: int, overlap: int):
    """Adds the boundaries that a chunk has in its own first `overlap` characters (head) and
    in those of its successor (tail), counted from the respective first character."""
    schema = pa.schema([*_CHUNKS, ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for whole in batches:
            for batch, _, _ in slices(whole, "part"):
                heads, tails = [], []
                for text, last in zip(batch.column("part").to_pylist(), batch.column("last").to_pylist()):
                    found = boundaries(text, compiled, last)
                    heads.append([b for b in found if b <= overlap])
                    tails.append([b - chunk for b in found if chunk <= b <= chunk + overlap])
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], schema=schema)

    return run


def _stitched(chunks: DataFrame, chunk: int) -> DataFrame:
    """(row, i, last, begin, stop, safe): each chunk's share of the text, from the boundary where it
    takes over to the one where its successor does; only these short lists are sorted."""
    order = W.partitionBy("row").orderBy("i")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    found = chunks.select("row", "i", "last", F.when(F.col("i") == 0, F.lit(0)).otherwise(met).alias("begin"))
    found = found.withColumn("safe", F.min(F.col("begin").isNotNull()).over(order))
    handed = F.lead("begin").over(order)
    return found.withColumn("stop", F.when(F.lead("safe").over(order), F.lit(chunk) + handed))


_TOKENS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("ids", pa.list_(pa.int32()))])
_TOKENS_DDL = "row long, doc_id long, i int, ids array<int>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _encode(rank_file: str, pattern: str):
    """Ids of `part`, which begins and ends at boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, compiled = load(rank_file), regex.compile(pattern)
        for whole in batches:
            for batch, _, _ in slices(whole, "part"):
                found = [bpe.known.all(compiled.findall(text)) for text in batch.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "doc_id", "i")), _lists(found)], schema=_TOKENS)

    return run


def _encode_shares(rank_file: str, pattern: str):
    """Ids of part[begin:stop]; the boundaries lie as in the whole text, since the part goes on
    to what follows its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, compiled = load(rank_file), regex.compile(pattern)
        for whole in batches:
            for batch, _, _ in slices(whole, "part"):
                found = []
                for text, begin, stop in zip(*(batch.column(n).to_pylist() for n in ("part", "begin", "stop"))):
                    pieces = []
                    for match in compiled.finditer(text, begin):
                        if stop is not None and match.start() >= stop:
                            break
                        pieces.append(match.group())
                    found.append(bpe.known.all(pieces))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "doc_id", "i")), _lists(found)], schema=_TOKENS)

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>), one row per row of `docs`."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    texts = ids_and_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One chunk needs no partner: such texts stay where they are.
    short = texts.filter(F.length("text") <= chunk).select(
        F.lit(0).cast("long").alias("row"), "doc_id", F.lit(0).alias("i"), F.col("text").alias("part")
    )
    short = short.mapInArrow(_encode(rank_file, pattern), _TOKENS_DDL).select("doc_id", "ids")

    long = texts.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = long.mapInArrow(_cut(chunk, overlap), _CHUNKS_DDL).repartition("row", "i")
    chunks = stage(chunks.mapInArrow(_split(pattern, chunk, overlap), _CHUNKS_DDL + ", head array<int>, tail array<int>"), "chunks")
    shares = chunks.select("row", "doc_id", "i", "part").join(_stitched(chunks, chunk), ["row", "i"])
    # The last safe chunk before an unsafe one and all that follow it are split as one text.
    alone = F.col("safe") & (F.col("stop").isNotNull() | F.col("last"))
    tokens = shares.filter(alone).select("row", "doc_id", "i", "part", "begin", "stop")
    tokens = tokens.mapInArrow(_encode_shares(rank_file, pattern), _TOKENS_DDL)
    core = F.when(F.col("last"), F.col("part")).otherwise(F.expr(f"substring(part, 1, {chunk})"))
    rest = shares.filter(~alone).select("row", "doc_id", "i", "begin", core.alias("part"))
    rest = rest.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("i", "begin", "part"))).alias("parts"))
    rest = rest.select(
        "row",
        "doc_id",
        F.col("parts")[0]["i"].alias("i"),
        F.expr("substring(array_join(transform(parts, p -> p.part), ''), parts[0].begin + 1)").alias("part"),
    )
    tokens = tokens.unionByName(rest.mapInArrow(_encode(rank_file, pattern), _TOKENS_DDL))
    joined = tokens.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts")
    )
    joined = joined.select("doc_id", F.flatten(F.col("parts")["ids"]).alias("ids"))
    return short.unionByName(joined)


def _decode(rank_file: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file)
        for batch in batches:
            found = [bpe.decode(ids.values.to_numpy()).tobytes() if ids.is_valid else b"" for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids").cast(schema.field("ids").type), pa.array(found, pa.binary())], schema=schema
            )

    return run


def decode(tokens: DataFrame, rank_file: str) -> DataFrame:
    """`tokens` (doc_id, ids) with the bytes of each row's ids."""
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        _decode(rank_file), "doc_id long, ids array<int>, bytes binary"
    )


def digests(docs: DataFrame, rank_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document the number of ids and digests of the ids and of what they decode to."""
    decoded = decode(encode(docs, rank_file, pattern, chunk, overlap), rank_file)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
