"""Words and word hashes of many texts at once, on Arrow's own UTF-8 buffers.

All word classes used here exclude ASCII characters only, so every byte from 0x80 on
belongs to a word and boundaries can be found on bytes. Nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_table(excluded: bytes) -> np.ndarray:
    """256 flags: which bytes belong to words."""
    flags = np.ones(256, dtype=bool)
    flags[list(excluded)] = False
    return flags


SPACE_WORDS = word_table(SPACES)
# Lower-case letters, digits and everything beyond ASCII.
ALNUM_WORDS = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; `seed` gives independent functions."""
    with np.errstate(over="ignore"):
        return _splitmix(x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


# Each byte value is replaced by a random 64-bit number before it enters the polynomial.
_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 77)
_BASE = 0x9FB21C651E98DF25  # odd, hence invertible modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of a number modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.values = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            while len(self.values) < n:
                step = np.uint64(pow(self.base, len(self.values), 1 << 64))
                self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


@dataclass
class Words:
    """Words of a run of texts.

    `starts`, `ends`: byte positions in `data`; `doc`: index of the text;
    `first`: for text i its words are first[i]:first[i + 1].
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, equal for equal words everywhere."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span data[start:end], equal for equal bytes everywhere."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUES[data] * _UP.upto(n), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _DOWN.upto(n + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64), 3)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of texts data[offsets[i]:offsets[i + 1]]; a text's end also ends a word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    change = np.diff(inside)
    starts = np.flatnonzero(change == 1)
    ends = np.flatnonzero(change == -1)
    # Words that run over the border of two texts are cut there.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    first = np.searchsorted(starts, offsets, side="left")
    return Words(data, starts, ends, first, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return _LOWER[data]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of `width` consecutive words: position i covers i..i+width-1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:n].copy()
        for k in range(1, width):
            total = total * _SHINGLE_BASE + hashes[k : k + n]
        return mix(total, 11 + width)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `limit` bytes of text each, so that work arrays stay
    small; a longer text is a part of its own, whole."""
    data, offsets = text_buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield (
            batch.slice(begin, end - begin),
            data[offsets[begin] : offsets[end]],
            offsets[begin : end + 1] - offsets[begin],
        )
        begin = end


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per run values[start:end] of 64-bit numbers."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _UP.upto(n), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _DOWN.upto(n + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64), 4)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0]..starts[0]+lengths[0]-1, starts[1].. and so on."""
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    steps = np.ones(total, dtype=np.int64)
    ends = np.cumsum(lengths)[:-1]
    steps[0] = starts[0]
    steps[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, an index of each, which of them each value is)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(values)]
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which
