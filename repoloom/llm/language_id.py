"""Language identification with hyperdimensional profiles.

Every character has a random vector of +1 and -1, derived from its code point. An n-gram is
its characters' vectors, shifted by their place and bound by multiplication; a text is the
sum of its n-grams; a language is the sum of its training texts. A text has the language of
the most similar prototype by cosine. Sums are whole numbers, so prototypes do not depend
on how the data is split; only these few vectors reach the driver.

Texts are lowered; a run of anything but letters counts as one space. Defined cases: a null
text or one without letters is `und` with score 0, and so is every text when nothing can be
learned (no labelled text outside the held-out fifth); equal cosines go to the language that
sorts first; rows with a null id are held out; rows that repeat count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.llm import textbytes

DIMENSION = 1024
GRAM = 3
FOLDS = 5
BLOCK_TEXTS = 256
BLOCK_GRAMS = 8192
UNKNOWN = "und"

_letters = np.full(0x110000, -1, dtype=np.int8)


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Flags per code point; each code point is looked up once per worker."""
    unseen = np.unique(points[_letters[points] < 0])
    if len(unseen):
        _letters[unseen] = [chr(p).isalpha() for p in unseen.tolist()]
    return _letters[points] == 1


def letter_vectors(points: np.ndarray, dimension: int) -> np.ndarray:
    """One row of +1 and -1 per code point."""
    seeds = textbytes.mix(points.astype(np.uint64), 900)[:, None]
    words = textbytes.mix(seeds + np.arange(dimension // 64, dtype=np.uint64), 901)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Rows for n-grams, given as columns of indexes into the letters' vectors."""
    bound = letters[grams[:, -1]]
    for place in range(1, grams.shape[1]):
        bound = bound * np.roll(letters, place, axis=1)[grams[:, -1 - place]]
    return bound


def grams_of(texts: list[str | None], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each n-gram, which distinct one it is, distinct n-grams as indexes, code points)."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _is_letter(points)
    points = np.where(letter, points, 32)
    # Runs of spaces shrink to one, within each text.
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    alphabet, index = np.unique(points, return_inverse=True)
    n = max(len(points) - gram + 1, 0)
    whole = np.flatnonzero(owner[:n] == owner[gram - 1 :]) if n else np.empty(0, np.int64)
    code = np.zeros(len(whole), dtype=np.int64)
    for k in range(gram):
        code = code * len(alphabet) + index[whole + k]
    kinds, which = np.unique(code, return_inverse=True)
    columns = [kinds // len(alphabet) ** (gram - 1 - k) % len(alphabet) for k in range(gram)]
    return owner[whole], which, np.stack(columns, axis=1), alphabet


def bundles(texts: list[str | None], groups: np.ndarray, n_groups: int, dimension: int, gram: int) -> np.ndarray:
    """Sum of n-gram vectors per group; groups[i] is the group of text i."""
    owner, which, grams, alphabet = grams_of(texts, gram)
    out = np.zeros((n_groups, dimension), dtype=np.float64)
    if not len(grams):
        return out
    letters = letter_vectors(alphabet, dimension)
    cells = np.bincount(groups[owner] * len(grams) + which, minlength=n_groups * len(grams))
    counts = cells.reshape(n_groups, len(grams)).astype(np.float32)
    for at in range(0, len(grams), BLOCK_GRAMS):
        vectors = gram_vectors(grams[at : at + BLOCK_GRAMS], letters).astype(np.float32)
        out += counts[:, at : at + BLOCK_GRAMS] @ vectors
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part, _, _ in textbytes.slices(batch, "text"):
        for at in range(0, part.num_rows, BLOCK_TEXTS):
            yield part.slice(at, BLOCK_TEXTS)


_SUMS = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.int64()))])


def _profile_batches(dimension: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _blocks(batch):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                groups = np.array([names.index(lang) for lang in langs])
                found = bundles(part.column("text").to_pylist(), groups, len(names), dimension, gram)
                for name, row in zip(names, np.rint(found).astype(np.int64)):
                    sums[name] = sums[name] + row if name in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], _SUMS.field(1).type)], schema=_SUMS)

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fifth that is never learned from."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def prototypes(labelled: DataFrame, dimension: int = DIMENSION, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Summed vector of each language in (text, lang); one row per language is collected."""
    sums = labelled.mapInArrow(_profile_batches(dimension, gram), "lang string, sums array<long>")
    cells = sums.select("lang", F.posexplode("sums").alias("place", "value"))
    cells = cells.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("sums")).collect()
    return {r["lang"]: np.array([c["value"] for c in r["sums"]], dtype=np.float64) for r in sorted(rows)}


_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(shared, dimension: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        for batch in batches:
            for part in _blocks(batch):
                texts = part.column("text").to_pylist()
                own = bundles(texts, np.arange(len(texts)), len(texts), dimension, gram)
                size = np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                cosines = (own / size) @ unit.T if names else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)
                known = [bool(names) and any(c.isalpha() for c in t or "") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, known)]),
                        pa.array([float(np.clip(row[b], 0, 1)) if ok else 0.0 for row, b, ok in zip(cosines, best, known)]),
                    ],
                    schema=_FOUND,
                )

    return run


def identify(docs: DataFrame, dimension: int = DIMENSION, gram: int = GRAM) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the other folds."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        held_out().alias("held_out"),
    )
    labelled = rows.filter("not held_out and lang is not null and text is not null").select("text", "lang")
    learned = prototypes(labelled, dimension, gram)
    names = list(learned)
    matrix = np.array([learned[n] for n in names]).reshape(len(names), dimension)
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((names, unit))
    return rows.select("doc_id", "text", "held_out").mapInArrow(
        _predict(shared, dimension, gram), "doc_id long, held_out boolean, lang_pred string, score double"
    )
