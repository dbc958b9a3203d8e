"""Ids against the tokenizer library itself, for whole texts and for every way of cutting them."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from samples import SCHEMA, frame, prose

from repoloom.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(rng, n):
    parts = [" ", "  ", "\n", "\t ", "'", "'l", "'ll", "don't", "aaaa", "1234567", "é", "ß", "漢字", "🙂", "<|endoftext|>", "=====", "\x00", " ", "word"]
    return "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(n))


def encoded(spark, rows, **sizes):
    found = byte_bpe.encode(frame(spark, rows), FILE, public_tokenizers.PATTERN, **sizes)
    return byte_bpe.decode(found, FILE).collect()


def test_pieces_stay_whole(library):
    known = byte_bpe.load(FILE).known
    for piece in ("a b", " two words", "x\ny", "", "ab" * 9000):
        wanted = library._encode_single_piece(piece.encode()) if piece else []
        assert known.all([piece, piece]).tolist() == wanted * 2


@pytest.mark.parametrize("chunk, overlap", [(16, 9), (40, 12), (200, 30), (1 << 14, 1 << 10)])
def test_chunks_equal_whole_text(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = [odd_text(rng, rng.randrange(1, 120)) for _ in range(60)] + ["x" * 500, " " * 300, "a b" * 100 + "z" * 100 + "!? " * 50, prose(rng, 50)]
    found = encoded(spark, list(enumerate(texts)), chunk=chunk, overlap=overlap)
    assert len(found) == len(texts)
    for row in found:
        assert row["ids"] == library.encode_ordinary(texts[row["doc_id"]]), texts[row["doc_id"]]
        assert bytes(row["bytes"]).decode() == texts[row["doc_id"]]


def test_boundaries_do_not_change_with_what_follows():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(200):
        text = odd_text(rng, 40)
        whole = set(byte_bpe.boundaries(text, pattern, True))
        cut = rng.randrange(len(text))
        assert set(byte_bpe.boundaries(text[:cut], pattern, False)) <= whole


def test_awkward_rows(spark, library):
    rows = [(None, "a text " * 9), (1, None), (1, ""), (2, "same"), (2, "other text " * 9), (2, "other text " * 9), (None, None)]
    found = encoded(spark, rows, chunk=20, overlap=10)
    wanted = sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == wanted


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    digests = byte_bpe.digests(docs, FILE, public_tokenizers.PATTERN)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 0


def test_unknown_ids_fail():
    with pytest.raises(ValueError):
        byte_bpe.load(FILE).decode(byte_bpe.np.array([50256]))
    with pytest.raises(ValueError):
        byte_bpe.load(FILE).decode(byte_bpe.np.array([-1]))


def test_query_on_supplied_documents(spark, library):
    """The registered query, at its own chunk size, against the library."""
    import hashlib
    import os

    from repoloom.llm import queries

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("supplied tables not present")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = queries.op11_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
