"""Tokens against the tokenizer, the program against bounds, places against a rebuild."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from repoloom.llm import packing, textbytes
from repoloom.llm.queries import tokenizer_path
from samples import frame, prose

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

PARTS = [*"aBcS'’.,!|<>()-9 \n\té", "W̊", "中–… İΣ\x1c\x85", "'RE", "'s", "<|endoftext|>", "<|STARTOFTEXT|>"]


def test_ids_are_the_tokenizers():
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    own = packing.WordTokens(tokenizer_path())
    rng = random.Random(2)
    for _ in range(800):
        parts = PARTS[: -2 if rng.random() < 0.7 else None]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 5))]
        ids, first = own.encode(*textbytes.text_buffers(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    own, plain = packing.WordTokens(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    for _ in range(20):
        text = prose(rng, 50, 500)
        ids, _ = own.encode(*textbytes.text_buffers(pa.array([text])))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_configurations_use_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = 200
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length in rng.integers(1, capacity + 1, 40):
        counts[length] += rng.integers(1, 50)
    used = np.zeros_like(counts)
    chosen = packing.configurations(counts, rounds=60)
    for members, times in chosen:
        assert times > 0 and sum(length * n for length, n in members.items()) <= capacity
        for length, n in members.items():
            used[length] += n * times
    assert (used == counts).all()
    solution, bound, _ = packing.fractional(counts, 60)
    total = sum(times for _, times in chosen)
    assert bound - 1e-6 <= sum(solution.values()) <= 1.04 * bound
    assert bound - 1e-6 <= total <= 1.02 * bound + 2


def test_no_pieces():
    assert packing.configurations(np.zeros(11, dtype=np.int64)) == []


def test_places_rebuild_the_documents(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.choice([1, 30, 400, 1200, 3000]), 3000)) for k in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (None, "x")]
    found = packing.pack(frame(spark, rows), tokenizer_path(), 1000).collect()
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [packing.END], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 1000)):
            own = ids[at : at + 1000]
            want.append((str(i), k, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1000
    total = sum(r["length"] for r in found)
    counts = np.bincount([r["length"] for r in found], minlength=1001)
    assert len(sequences) <= 1.01 * max(packing.fractional(counts)[1], total / 1000) + 1


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0
