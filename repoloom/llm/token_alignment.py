"""Alignment of two tokenizers on the bytes they share.

A tokenizer's tokens of a text and the text's bytes form an incidence matrix: one row per
token, ones at the token's bytes. It is kept as compressed sparse rows made by hand (`Rows`).
With A and B for the two tokenizers the product A x B' has an entry where two tokens share
bytes, and its value says how many: the overlap links. Byte offsets at which tokens of both
end cut the text into groups; the token-group incidences G and H give G x H', whose entries
are the links within a group. Both products are Gustavson's: for each row of the left matrix
the rows of the right one that its entries name, merged by column.

A link's count is how many links of the whole corpus join the same two ids. Documents are
tokenised and multiplied once, in blocks with bounded text; a block is cut into stretches of
documents, and those at group ends into runs, before matrices are made, so that work arrays
stay small whatever a text's length. What is left of a document is one row: its measures,
and a sparse row over the block's id pairs that says how many of its links join each. Ids
aren't kept, and no row holds more than one document. Counts meet the blocks by a join on the
id pair, in which a block names each of its pairs once, so a pair that every text holds
weighs one row per block; the sparse rows times the pairs' counts give the documents' sums.

Parameters: the two tokenizer files, `block_bytes` of text per block, `run_bytes` per product.

Defined results. Null and empty texts, and texts that a tokenizer doesn't give back byte by
byte, have no tokens: zeros and an empty group string. Rows stay apart whatever their id:
repeated and null ids give one row each, and every row counts. Columns other than id and text
are not used, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.tables import ids_and_texts, stage
from repoloom.llm.textbytes import ranges, slices

BLOCK_BYTES = 1 << 22
RUN_BYTES = 1 << 19

# --- Tokenizers --------------------------------------------------------------------


class Tokens:
    """A tokenizer's ids of a space and a text, and the bytes of its ids."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def encode(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, joined."""
        return self.bytes[ranges(self.places[ids], self.sizes[ids])]


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable Latin-1 stands for itself, every
    other byte for the next free letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel(Tokens):
    """A byte-level tokenizer file. Where its merges come in the order of their ids, as in the
    usual ones, ids serve as ranks; else its own library encodes."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        pieces = [b""] * (max(model["vocab"].values()) + 1)
        for token, number in model["vocab"].items():
            if all(c in letters for c in token):
                pieces[number] = bytes(letters[c] for c in token)
        super().__init__(pieces)
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"][m.replace(" ", "")] for m in merges]
        if made == sorted(set(made)):
            ranks = {p: k for k, p in enumerate(pieces) if p}
            ranked = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._encode = lambda text: ranked.encode_to_numpy(text, disallowed_special=())
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(" " + text).astype(np.int64)


class Pieces(Tokens):
    """A sentence-piece model, which puts a space before the text itself.

    Its merges are those of ranks, where letters are first made from their bytes: a byte
    prefix of a letter is a part of its own with the lowest ranks, then come letters, then
    longer pieces by falling score. Prefixes that no letter took are spelled in byte ids
    afterwards. Pieces that the merges don't give back whole, and texts that the model changes
    before it encodes them, are left to its own library.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, of_byte, letters, longer = [], {}, {}, []
        for k in range(model.get_piece_size()):
            name = model.id_to_piece(k)
            if model.is_byte(k):
                pieces.append(bytes([int(name[1:-1], 16)]))
                of_byte[pieces[k]] = k
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                pieces.append(b"")
            else:
                pieces.append(name.replace("▁", " ").encode("utf-8"))
                if len(name) == 1:
                    letters[pieces[k]] = k
                else:
                    longer.append(k)
        super().__init__(pieces)
        prefixes = sorted({p[:n] for p in letters for n in range(2, len(p))}, key=lambda p: (len(p), p))
        parts = [bytes([b]) for b in range(256)] + prefixes + sorted(p for p in letters if len(p) > 1)
        parts += [pieces[k] for k in sorted(longer, key=lambda k: -model.get_score(k))]
        spelled = [[letters[p]] if p in letters else [of_byte[bytes([b])] for b in p] for p in parts[: 256 + len(prefixes)]]
        spelled += [[letters[p]] for p in parts[256 + len(prefixes) :] if p in letters]
        spelled += [[k] for k in sorted(longer, key=lambda k: -model.get_score(k))]
        self.spelled_sizes = np.array([len(x) for x in spelled])
        self.is_prefix = self.spelled_sizes > 1
        self.spelled_first = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        self.spelled = np.array([k for x in spelled for k in x], dtype=np.int64)
        # If no piece goes on behind a space that follows another character, no merge does.
        by_words = not any(regex.search(rb"[^ ] ", p) for p in pieces)
        self.ranked = tiktoken.Encoding(
            "pieces",
            pat_str=r" +[^ ]*|[^ ]+" if by_words else r"(?s:.+)",
            mergeable_ranks={p: k for k, p in enumerate(parts)},
            special_tokens={},
        )
        words = [pieces[k].decode()[1:] for k in longer if pieces[k][:1] == b" "]
        odd = [w for w, ids in zip(words, model.encode(words, num_threads=1)) if w and len(ids) != 1]
        self.odd = regex.compile("|".join(regex.escape(f" {w}") + r"(?= |$)" for w in odd)) if odd else None

    def encode(self, text: str) -> np.ndarray:
        spaced = " " + text
        if "▁" in text or self.model.normalize(text) != spaced.replace(" ", "▁") or (self.odd and self.odd.search(spaced)):
            return np.array(self.model.encode(text), dtype=np.int64)
        found = self.ranked.encode_to_numpy(spaced, disallowed_special=())
        if not self.is_prefix[found].any():
            return self.spelled[self.spelled_first[found]]
        return self.spelled[ranges(self.spelled_first[found], self.spelled_sizes[found])]


@dataclass(frozen=True)
class Pair:
    """The two tokenizers: a byte-level file with its pattern, and a sentence-piece model."""

    byte_level: str
    pattern: str
    pieces: str

    def load(self) -> tuple[Tokens, Tokens]:
        if self not in _loaded:
            _loaded[self] = (ByteLevel(self.byte_level, self.pattern), Pieces(self.pieces))
        return _loaded[self]


_loaded: dict[Pair, tuple[Tokens, Tokens]] = {}


def tokenise(text: str | None, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Ids by both tokenizers; none if either doesn't give back a space and the text."""
    if text:
        wanted = np.frombuffer((" " + text).encode("utf-8"), dtype=np.uint8)
        ids = a.encode(text), b.encode(text)
        if all(np.array_equal(tokens.spell(i), wanted) for tokens, i in zip((a, b), ids)):
            return ids
    return np.empty(0, np.int64), np.empty(0, np.int64)


# --- Matrices ----------------------------------------------------------------------


@dataclass
class Rows:
    """Compressed sparse rows with ones: row r has columns columns[first[r]:first[r + 1]]."""

    first: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, starts: np.ndarray, ends: np.ndarray, width: int) -> "Rows":
        """Row r has the columns starts[r]..ends[r] - 1."""
        first = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=first[1:])
        if (starts[1:] == ends[:-1]).all():
            return cls(first, np.arange(starts[0], ends[-1]), width)
        return cls(first, ranges(starts, ends - starts), width)

    def transposed(self) -> "Rows":
        """Entries of each column, in order of their rows."""
        height = len(self.first) - 1
        first = np.zeros(self.width + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=first[1:])
        rows = np.repeat(np.arange(height), np.diff(self.first))
        if (np.diff(self.columns) < 0).any():
            rows = rows[np.argsort(self.columns, kind="stable")]
        return Rows(first, rows, height)

    def times(self, right: "Rows") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product's entries, by rows: each entry of a left row
        fetches a row of the right matrix, and what a row fetched is merged by column."""
        sizes = np.diff(right.first)[self.columns]
        rows = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        if (sizes == 1).all():
            fetched = right.columns[right.first[self.columns]]
        else:
            fetched, rows = right.columns[ranges(right.first[self.columns], sizes)], np.repeat(rows, sizes)
        key = rows * right.width + fetched
        if len(key) and (np.diff(key) < 0).any():
            key = np.sort(key)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        value = np.diff(np.append(new, len(key)))
        return key[new] // right.width, key[new] % right.width, value


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens of both end (sorted inputs without repeats)."""
    ends = np.zeros(max(a_ends[-1:].tolist() + b_ends[-1:].tolist(), default=0) + 1, dtype=bool)
    ends[b_ends] = True
    return a_ends[ends[a_ends]]


def _runs(a_ends: np.ndarray, b_ends: np.ndarray, groups: np.ndarray, most: int) -> Iterator[tuple[slice, slice, int]]:
    """Runs of whole groups of about `most` bytes: tokens of both, and the first byte."""
    low = 0
    while len(groups) and low < groups[-1]:
        k = np.searchsorted(groups, low + most, side="right") - 1
        high = groups[k] if k >= 0 and groups[k] > low else groups[np.searchsorted(groups, low, side="right")]
        yield (
            slice(*np.searchsorted(a_ends, [low, high], side="right")),
            slice(*np.searchsorted(b_ends, [low, high], side="right")),
            int(low),
        )
        low = high


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(token of A, token of B, shared bytes) of all links of a run of tokens."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    for some_a, some_b, low in _runs(a_ends, b_ends, group_ends(a_ends, b_ends), most):
        ends = a_ends[some_a] - low, b_ends[some_b] - low
        a, b = (Rows.of_spans(e - s[k], e, int(e[-1])) for e, s, k in zip(ends, (a_sizes, b_sizes), (some_a, some_b)))
        i, j, shared = a.times(b.transposed())
        yield i + some_a.start, j + some_b.start, shared


def group_links(a_sizes: np.ndarray, b_sizes: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(token of A, token of B, group) of all links within groups."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    groups = group_ends(a_ends, b_ends)
    for some_a, some_b, _ in _runs(a_ends, b_ends, groups, most):
        g, h = (np.searchsorted(groups, ends[k]) for ends, k in ((a_ends, some_a), (b_ends, some_b)))
        first = g[0]
        width = int(g[-1] - first) + 1
        left, right = (Rows(np.arange(len(x) + 1), x - first, width) for x in (g, h))
        i, j, _ = left.times(right.transposed())
        yield i + some_a.start, j + some_b.start, g[i]


# --- Blocks of documents -------------------------------------------------------------


class Stretch:
    """Neighbouring documents of a block: their ids and sizes by both tokenizers, joined.
    Documents without tokens take part with none."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], tokens: tuple[Tokens, Tokens]):
        self.first = [np.cumsum([0, *(len(f[side]) for f in found)]) for side in (0, 1)]
        self.ids = [np.concatenate([f[side] for f in found]) for side in (0, 1)]
        self.sizes = [t.sizes[i] for t, i in zip(tokens, self.ids)]

    def __len__(self) -> int:
        return len(self.first[0]) - 1

    def documents(self, i: np.ndarray) -> np.ndarray:
        """The document of each token of A."""
        return np.searchsorted(self.first[0], i, side="right") - 1


def stretches(texts: pa.Array, tokens: tuple[Tokens, Tokens], most: int = RUN_BYTES, most_docs: int = 1 << 16) -> Iterator[Stretch]:
    """All documents, in stretches of about `most` bytes; a longer text is one of its own."""
    found, held = [], 0
    for text in texts:
        size = len(text.as_buffer() or b"")
        if found and (held + size > most or len(found) == most_docs):
            yield Stretch(found, tokens)
            found, held = [], 0
        found.append(tokenise(text.as_py(), *tokens))
        held += size
    if found:
        yield Stretch(found, tokens)


def _summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their times (1 each if not given)."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if times is None:
        return keys[new], np.diff(np.append(new, len(keys)))
    return keys[new], np.add.reduceat(times, new) if len(new) else times


def document_pairs(stretch: Stretch, tokens: tuple[Tokens, Tokens]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of a stretch, in order; `pair` is the id of A times the number of
    ids of B, plus the id of B."""
    width = tokens[1].count
    bits = _pair_bits(tokens)
    found = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting, held = [], 0
    for i, j, _ in overlap_links(*stretch.sizes):
        waiting.append(_summed((stretch.documents(i) << bits) | (stretch.ids[0][i] * width + stretch.ids[1][j])))
        held += len(waiting[-1][0])
        if held > len(found[0]):  # so runs of a long text are merged a few times only
            found = _merged([found, *waiting])
            waiting, held = [], 0
    keys, links = _merged([found, *waiting]) if waiting else found
    return keys >> bits, keys & ((1 << bits) - 1), links


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    some = [p for p in parts if len(p[0])]
    return some[0] if len(some) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts)))


def _pair_bits(tokens: tuple[Tokens, Tokens]) -> int:
    return (tokens[0].count * tokens[1].count).bit_length()


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per document the bytes of values[first[d]:first[d + 1]]."""
    places = pa.py_buffer((first * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(values))])


_PAIR = [(n, pa.int64()) for n in ("pair", "links")]
_DOCUMENT = [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links")] + [
    ("groups_sha256", pa.string()),
    ("places", pa.binary()),
    ("times", pa.binary()),
]
_BLOCK = pa.schema([("block", pa.int64()), *_PAIR, *_DOCUMENT])
_BLOCK_DDL = (
    "block long, pair long, links long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, "
    "groups_sha256 string, places binary, times binary"
)


def _rows(block: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of `blocks`; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    columns["block"] = pa.array(np.full(n, block, np.int64))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _BLOCK], schema=_BLOCK)


def _block_rows(block: int, docs: pa.RecordBatch, tokens: tuple[Tokens, Tokens], names: tuple) -> Iterator[pa.RecordBatch]:
    measures, hashes, parts = [], [], []
    for stretch in stretches(docs.column("text"), tokens, most_docs=1 << (63 - _pair_bits(tokens))):
        n_groups, n_group_links = np.zeros((2, len(stretch)), dtype=np.int64)
        ends = [np.cumsum(s) for s in stretch.sizes]
        groups = group_ends(*ends)
        group = [np.searchsorted(groups, e) for e in ends]
        for d in range(len(stretch)):
            spans = [slice(first[d], first[d + 1]) for first in stretch.first]
            ids, own = [stretch.ids[s][spans[s]] for s in (0, 1)], [group[s][spans[s]] for s in (0, 1)]
            if not len(ids[0]):
                hashes.append("")
                continue
            low, high = own[0][0], own[0][-1] + 1
            n_groups[d] = high - low
            n_group_links[d] = (np.bincount(own[0] - low) * np.bincount(own[1] - low)).sum()
            hashes.append(hashlib.sha256(group_text(*ids, *own, names).encode()).hexdigest())
        doc, pair, links = document_pairs(stretch, tokens)
        entries = np.bincount(doc, minlength=len(stretch))
        ends = np.cumsum(np.append(0, links))[np.cumsum(np.append(0, entries))]
        measures.append((*(np.diff(f) for f in stretch.first), n_groups, np.diff(ends), n_group_links, entries))
        parts.append((pair, links.astype(np.min_scalar_type(links.max(initial=0)))))
    pair, times = (np.concatenate(x) for x in zip(*parts))
    pairs = np.unique(pair)
    places = np.searchsorted(pairs, pair).astype(_narrow(len(pairs)))
    links = np.bincount(places, weights=times, minlength=len(pairs)).astype(np.int64)
    if len(pairs):
        pairs = (pairs // tokens[1].count << 32) | pairs % tokens[1].count
        yield _rows(block, pair=pa.array(pairs), links=pa.array(links))
    *counts, entries = (np.concatenate(x) for x in zip(*measures))
    first = np.cumsum(np.append(0, entries))
    yield _rows(
        block,
        doc_id=docs.column("doc_id"),
        **{n: pa.array(c) for n, c in zip(("n_a", "n_b", "n_groups", "n_links", "n_group_links"), counts)},
        groups_sha256=pa.array(hashes, pa.string()),
        places=_binaries(places, first),
        times=_binaries(times, first),
    )


def _narrow(count: int) -> np.dtype:
    """What holds the places of so many pairs."""
    return np.dtype("<u2" if count <= 1 << 16 else "<u4")


def _tokenise(pair: Pair, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = pair.load()
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch, _, _ in slices(whole, "text", block_bytes):
                yield from _block_rows(block, batch, tokens, _names(tokens))
                block += 1

    return run


def blocks(docs: DataFrame, pair: Pair, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds. With a pair: (block, pair, links), the distinct id pairs of a run of
    documents, in order, and their links in it. Without: a document's measures and its sparse
    row, `places` in the block's pairs and how many `times` each is linked."""
    return ids_and_texts(docs).mapInArrow(_tokenise(pair, block_bytes), _BLOCK_DDL)


def pair_links(made: DataFrame) -> DataFrame:
    """(block, pair, links) of staged blocks; `pair` is the id of A times 2^32 plus that of B."""
    return made.where("pair is not null").select(F.col("block").alias("block"), F.col("pair").alias("pair"), "links")


def documents(made: DataFrame) -> DataFrame:
    """(block, doc_id, measures, places, times) of staged blocks."""
    return made.where("pair is null").drop("pair", "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): links of the whole corpus, and whether no pair of the same id of B
    has more."""
    counts = links.groupBy("pair").agg(F.sum("links").alias("count"))
    counts = counts.withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


# --- Results -------------------------------------------------------------------------


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, names: tuple) -> str:
    """`a1,a2|b1;a3|b2,b3`: for each group the ids of both sides, decimal and in order.
    `names` has for each side all decimal ids followed by a comma, then all followed by the
    sign that ends that side of a group."""
    a_rank = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, side="left")
    b_rank = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")
    out = np.empty(len(a_ids) + len(b_ids), dtype=object)
    for ids, group, rank, side in ((a_ids, a_group, a_rank, names[0]), (b_ids, b_group, b_rank, names[1])):
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        out[rank] = side[ids + last * (len(side) // 2)]
    return "".join(out.tolist())[:-1]


_named: dict[tuple[int, int], tuple] = {}


def _names(tokens: tuple[Tokens, Tokens]) -> tuple:
    """The decimal ids that `group_text` joins, made once per Python worker."""
    key = tuple(t.count for t in tokens)
    if key not in _named:
        _named[key] = tuple(
            np.array([f"{k}{sign}" for sign in signs for k in range(n)], dtype=object) for n, signs in zip(key, (",|", ",;"))
        )
    return _named[key]


_RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links")]
    + [("groups_sha256", pa.string())]
)
_RESULT_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, n_group_links long, groups_sha256 string"
)


def _measure(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents and the counts of its pairs: sparse rows times counts."""
    order = np.argsort(right.column("pair").to_numpy())
    count, best = (right.column(n).to_numpy()[order] for n in ("count", "best"))
    sums = []
    for row in zip(left.column("places").to_pylist(), left.column("times").to_pylist()):
        if not row[0]:
            sums.append((0, 0))
            continue
        places = np.frombuffer(row[0], dtype=_narrow(len(count)))
        times = np.frombuffer(row[1], dtype=f"<u{len(row[1]) // len(places)}").astype(np.int64)
        sums.append((times[best[places]].sum(), (count[places] * times).sum()))
    n_best, count_sum = np.array(sums, dtype=np.int64).reshape(-1, 2).T
    more = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.Table.from_arrays([more[f.name] if f.name in more else left.column(f.name).cast(f.type) for f in _RESULT], schema=_RESULT)


def align(docs: DataFrame, pair: Pair, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: tokens of both, groups, links, links of the highest count of their id of B
    (n_best), the sum of the links' counts, links within groups, digest of the groups."""
    made = stage(blocks(docs, pair, block_bytes), "blocks")
    links = pair_links(made)
    scores = links.join(pair_counts(links), "pair").select("block", "pair", "count", "best")
    return documents(made).groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(_measure, _RESULT_DDL)


def _explode(pair: Pair, kind: str, block_bytes: int):
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("a_place", "b_place", "a_id", "b_id", "value")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair.load()
        product = overlap_links if kind == "overlap" else group_links
        for whole in batches:
            for batch, _, _ in slices(whole, "text", block_bytes):
                docs, groups = 0, 0
                for stretch in stretches(batch.column("text"), tokens):
                    own = batch.column("doc_id").slice(docs, len(stretch))
                    for i, j, value in product(*stretch.sizes):
                        doc = stretch.documents(i)
                        columns = [i - stretch.first[0][doc], j - stretch.first[1][doc], stretch.ids[0][i], stretch.ids[1][j], value]
                        columns[-1] = value if kind == "overlap" else value + groups
                        yield pa.RecordBatch.from_arrays(
                            [own.take(pa.array(doc)), *(pa.array(c.astype(np.int64)) for c in columns)], schema=schema
                        )
                    docs += len(stretch)
                    groups += len(group_ends(*(np.cumsum(s) for s in stretch.sizes))) if kind == "group" else 0

    return run


def links(docs: DataFrame, pair: Pair, kind: str = "overlap", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All links of all documents: places and ids of both tokens, with the bytes they share
    (`overlap`) or the number of their group in its block (`group`)."""
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of link: {kind}")
    exploded = "doc_id long, a_place long, b_place long, a_id long, b_id long, value long"
    return ids_and_texts(docs).mapInArrow(_explode(pair, kind, block_bytes), exploded)
