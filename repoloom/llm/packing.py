"""Packing of tokenised documents into sequences by a configuration linear program.

Spark tokenises, counts pieces per length, and places every piece. Only the histogram of
lengths (at most `capacity` numbers, however many documents there are) is solved on the
driver:

* A configuration is a multiset of lengths that fits a sequence; the program covers the
  histogram with as few configurations as it can. Multiplicative weights keep a price for
  each length. A round prices by a knapsack dynamic program over all capacities, whose
  table gives the best configuration with each length as its first member; their use
  raises coverage and the prices of lengths that lag behind.
* Fractions are rounded down; what remains is filled by the same dynamic program on the
  rest, then by largest-first filling. Every step uses a configuration as often as the
  counts allow, so the work depends on the number of lengths and not of pieces.

Pieces are numbered within their length by partial counts over hashed buckets, so a length
that is very common is not gathered in one task; a piece finds its place by its number.

Defined cases: a null or empty text is its end token alone; a document longer than the
capacity is cut into full pieces and a last, shorter one; equal rows are packed each; rows
with a null id too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from repoloom.llm import textbytes
from repoloom.llm.tables import ids_and_texts, stage

CAPACITY = 4096
END = 1
ROUNDS = 40
_RATE = 0.2
BATCH = 4000
CACHED_WORDS = 1_500_000
BUCKET_ROWS = 100_000

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- Tokens ------------------------------------------------------------------------


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
# ASCII punctuation except for the apostrophe, which can begin a contraction.
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class WordTokens:
    """Token ids of whole texts by a tokenizer that lowers case and drops white space.

    Its tokens never cross ASCII white space, nor the border of an ASCII letter and an ASCII
    mark other than an apostrophe; ASCII words are lowered by it anyway. So a text's ids are
    those of such parts, in order. (Where a special token may stand in a text, only white
    space parts it.) Ids of parts already seen are kept, for at most `CACHED_WORDS` parts.
    """

    def __init__(self, path: str):
        # Tasks run side by side already; threads below them would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last_in_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.last_in_word[number] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        # Two levels, so that the large one is seldom merged: keys sorted, with the place of
        # their ids; row k of a level is (key, begin, size).
        self.levels = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))] * 2
        self.ids = np.empty(0, dtype="<u4")

    def _tokenise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(begins, sizes) of the ids of each text, which are appended to all ids."""
        sizes = np.zeros(len(texts), dtype=np.int64)
        flat: list[np.ndarray] = []
        order: list[int] = []
        # A text of letters only is one word of the vocabulary, whose last id says so. Many
        # of them are one call.
        words = [k for k, text in enumerate(texts) if text.isalpha()]
        for at in range(0, len(words), BATCH):
            some = words[at : at + BATCH]
            line = " ".join([texts[k] for k in some])
            ids = np.array(self.tokenizer.encode(line, add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.last_in_word[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                sizes[some] = np.diff(ends, prepend=-1)
                flat.append(ids)
                order += some
        left = np.ones(len(texts), dtype=bool)
        left[order] = False
        rest = np.flatnonzero(left).tolist()
        for at in range(0, len(rest), BATCH):
            some = rest[at : at + BATCH]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
            sizes[some] = [len(ids) for ids in found]
            flat.append(np.fromiter(chain.from_iterable(found), dtype="<u4"))
            order += some
        own = sizes[order]
        begins = np.empty(len(texts), dtype=np.int64)
        begins[order] = len(self.ids) + np.cumsum(own) - own
        self.ids = np.concatenate([self.ids, *flat])
        return begins, sizes

    def _merge(self, level: int, rows: tuple[np.ndarray, ...]) -> None:
        joined = [np.concatenate(pair) for pair in zip(self.levels[level], rows)]
        order = np.argsort(joined[0], kind="stable")
        self.levels[level] = tuple(column[order] for column in joined)

    def _look_up(self, kinds: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """(begins, sizes) of sorted distinct keys; unknown ones are tokenised."""
        begins, sizes = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        missing = np.arange(len(kinds))
        for keys, begin, size in self.levels:
            if len(keys) and len(missing):
                at = np.minimum(np.searchsorted(keys, kinds[missing]), len(keys) - 1)
                hit = keys[at] == kinds[missing]
                begins[missing[hit]], sizes[missing[hit]] = begin[at[hit]], size[at[hit]]
                missing = missing[~hit]
        if len(missing):
            begins[missing], sizes[missing] = self._tokenise(text_of(missing))
            self._merge(1, (kinds[missing], begins[missing], sizes[missing]))
            if len(self.levels[1][0]) > CACHED_WORDS // 16:
                self._merge(0, self.levels[1])
                self.levels[1] = tuple(column[:0] for column in self.levels[1])
        return begins, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins)."""
        words = textbytes.find_words(data, offsets, textbytes.SPACE_WORDS)
        starts, ends, first = words.starts, words.ends, words.first
        if len(starts) and b"<|" not in data.tobytes():
            wide = np.maximum.reduceat(data, starts) >= 0x80  # up to the next word: no other such bytes
            low = textbytes.lowered(data)
            kept = textbytes.ranges(starts[wide], (ends - starts)[wide])
            low[kept] = data[kept]
            data = low
            letter, mark = _LETTER[data], _MARK[data]
            border = np.zeros(len(data) + 1, dtype=bool)
            border[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
            border[offsets] = False  # a border of texts, where no space stands, is a start already
            begin, end = border.copy(), border
            begin[starts] = end[ends] = True
            starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
            first = np.searchsorted(starts, offsets, side="left")
        kinds, sample, which = textbytes.distinct(textbytes.span_hashes(data, starts, ends))
        if len(self.levels[0][0]) > CACHED_WORDS:
            self._forget()

        def text_of(new: np.ndarray) -> list[str]:
            raw = data.tobytes()
            spans = zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())
            return [raw[a:b].decode("utf-8", "replace") for a, b in spans]

        begins, sizes = self._look_up(kinds, text_of)
        per_part = sizes[which]
        ids = self.ids[textbytes.ranges(begins[which], per_part)]
        upto = np.concatenate([[0], np.cumsum(per_part)])
        return ids, upto[first]


_tokenizers: dict[str, WordTokens] = {}


def _piece_batches(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokens(path)
        tokens = _tokenizers[path]
        end = np.array([END], dtype="<u4")
        for batch in batches:
            for part, data, offsets in textbytes.slices(batch, "text"):
                ids, first = tokens.encode(data, offsets)
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.concatenate([ids[first[i] : first[i + 1]], end])
                    for k, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity].tobytes()
                        rows.append((doc_id, k, at, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, _PIECES.field(k).type) for k, values in enumerate(zip(*rows))], schema=_PIECES
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""
    return ids_and_texts(docs).mapInArrow(_piece_batches(tokenizer, capacity), _PIECES_DDL)


# --- The program over the histogram ------------------------------------------------


def _knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within each capacity, and its first length (0: leave one unit)."""
    capacity = len(prices) - 1
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        total = prices[1 : c + 1] + best[c - 1 :: -1] if c > 1 else prices[1:2] + best[:1]
        k = int(np.argmax(total))
        if total[k] > best[c - 1]:
            best[c], choice[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def _configuration(first: int, choice: np.ndarray) -> dict[int, int]:
    """`first` and the best filling of the room that it leaves."""
    members = {first: 1}
    room = len(choice) - 1 - first
    while room > 0:
        length = int(choice[room])
        if length:
            members[length] = members.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return members


def fractional(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float, np.ndarray]:
    """(configuration -> fractional number of sequences, lower bound on the sequences, prices).

    Prices settle in a first half of the rounds; the second half makes up the solution, an
    equal share of the counts in each round.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    prices = np.where(counts > 0, np.arange(capacity + 1) / capacity, -np.inf)
    solution: dict[tuple, float] = {}
    bound = 0.0
    covered, share = np.zeros(capacity + 1), 0.0
    for r in range(2 * rounds):
        if r == rounds:
            covered, share = np.zeros(capacity + 1), 0.0
        share += 1 / rounds
        best, choice = _knapsack(prices)
        # Prices scaled by the best configuration are a feasible dual solution.
        bound = max(bound, float(counts[lengths] @ prices[lengths]) / best[capacity])
        target = counts * share
        for length in lengths[::-1].tolist():
            lack = target[length] - covered[length]
            if lack <= 0:
                continue
            members = _configuration(length, choice)
            amount = lack / members[length]
            for other, n in members.items():
                covered[other] += amount * n
            if r >= rounds:
                key = tuple(sorted(members.items(), reverse=True))
                solution[key] = solution.get(key, 0.0) + amount
        # A length is too cheap if its best configuration is below the best of all, and too
        # dear if it is covered beyond its share.
        worth = (prices[lengths] + best[capacity - lengths]) / best[capacity]
        beyond = np.clip(covered[lengths] / target[lengths] - 1, 0, 1)
        prices[lengths] *= np.exp(_RATE * (1 - worth - beyond))
    return solution, bound, prices


def _largest_first(left: np.ndarray, capacity: int) -> dict[int, int]:
    """One configuration of what is left: always the largest length that fits."""
    members: dict[int, int] = {}
    room = capacity
    lengths = np.flatnonzero(left)
    while True:
        k = int(np.searchsorted(lengths, room, side="right")) - 1
        while k >= 0 and members.get(int(lengths[k]), 0) >= left[lengths[k]]:
            k -= 1
        if k < 0:
            return members
        length = int(lengths[k])
        members[length] = members.get(length, 0) + 1
        room -= length


def _used_up(counts: np.ndarray, plans) -> list[tuple[dict[int, int], int]]:
    """Configurations from `plans` (generators of (members, most times) given what is left),
    each as often as the counts allow, then largest-first ones until nothing is left."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[dict[int, int], int]] = []

    def use(members: dict[int, int], most: float) -> int:
        times = int(min([most, *(left[length] // n for length, n in members.items())]))
        if times > 0:
            for length, n in members.items():
                left[length] -= times * n
            chosen.append((members, times))
        return times

    for plan in plans:
        for members, most in plan(left):
            use(members, most)
    while left.any():
        use(_largest_first(left, len(counts) - 1), np.inf)
    return chosen


def configurations(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(members, times) that use every length exactly counts[length] times: the rounded
    program, or largest-first filling alone in the rare case that it needs fewer."""
    if not counts.any():
        return []
    capacity = len(counts) - 1
    solution, _, prices = fractional(counts, rounds)
    value = lambda key: sum(prices[length] * n for length, n in key)
    fill = lambda members: sum(length * n for length, n in members.items())

    def rounded(left):
        for key, amount in sorted(solution.items(), key=lambda kv: (-value(kv[0]), -kv[1])):
            yield dict(key), np.floor(amount)

    def filled(left):
        # Longer lengths are worth a little more, so that they go while short ones remain.
        for _ in range(rounds):
            lengths = np.flatnonzero(left)
            if not len(lengths):
                return
            worth = np.full(capacity + 1, -np.inf)
            worth[lengths] = lengths * (1 + 0.01 * lengths / capacity)
            _, choice = _knapsack(worth)
            before = left.sum()
            for length in lengths[::-1].tolist():
                members = _configuration(length, choice)
                if fill(members) >= capacity - 1:
                    yield members, np.inf
            if left.sum() == before:
                return

    found = _used_up(counts, [rounded, filled])
    plain = _used_up(counts, [])
    total = lambda chosen: sum(times for _, times in chosen)
    return min(found, plain, key=total)


# --- Places ------------------------------------------------------------------------


def _places(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of its numbers: which numbers fall into which sequences."""
    rows, sequence = [], 0
    taken: dict[int, int] = {}
    for members, times in chosen:
        offset = 0
        for length, n in sorted(members.items(), reverse=True):
            low = taken.get(length, 0)
            rows.append((length, low, n, sequence, offset))
            taken[length] = low + n * times
            offset += length * n
        sequence += times
    rows.sort()
    names = ("length", "low", "copies", "sequence", "offset")
    return {name: np.array([r[k] for r in rows], dtype=np.int64) for k, name in enumerate(names)}


def _place(shared):
    schema = pa.schema(
        [(n, _PIECES.field(n).type) for n in _PIECES.names[:5]] + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table["length"] << 48) + table["low"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            row = np.searchsorted(keys, (length << 48) + number, side="right") - 1
            within = number - table["low"][row]
            copies = table["copies"][row]
            sequence = table["sequence"][row] + within // copies
            offset = table["offset"][row] + within % copies * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in _PIECES.names[:5]] + [pa.array(sequence), pa.array(offset)], schema=schema
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = stage(pieces(docs, tokenizer, capacity), "pieces")
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(_places(configurations(counts)))
    buckets = int(counts.sum()) // BUCKET_ROWS + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(
        "length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    numbered = rows.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    numbered = numbered.select(*_PIECES.names[:5], (F.col("before") + F.col("r")).cast("long").alias("number"))
    return numbered.mapInArrow(
        _place(shared),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
