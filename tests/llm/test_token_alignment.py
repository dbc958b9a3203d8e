"""Links, groups and counts against nested loops over tokens encoded by the libraries."""

import hashlib
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from samples import SCHEMA, frame, prose

from repoloom.llm import token_alignment as ta

PAIR = ta.Pair(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
)
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PAIR.byte_level)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PAIR.pieces)


def odd_text(rng, n):
    parts = [" ", "  ", "\n", "\t", "don't", "aaaa", "12345", "é", "漢字", "🙂", "<|endoftext|>", "<s>", "\x00", " ", "word", "_", "unbelievable"]
    return "".join(rng.choice(parts) for _ in range(n))


def direct(texts, libraries):
    """{key: the eight values} by nested loops."""
    a, b = libraries
    letters = ta._byte_letters()
    documents, counts = {}, Counter()
    for key, text in texts:
        documents[key] = None
        if not text:
            continue
        a_ids = a.encode(" " + text, add_special_tokens=False).ids
        b_ids = b.encode(text)
        a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [
            bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids
        ]
        wanted = (" " + text).encode()
        if b"".join(a_bytes) != wanted or b"".join(b_bytes) != wanted:
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = np.cumsum([len(p) for p in parts])
            spans.append([(e - len(p), e) for p, e in zip(parts, ends)])
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append([[i for i, (s, e) in zip(ids, span) if low <= s and e <= high] for ids, span in zip((a_ids, b_ids), spans)])
            low = high
        documents[key] = (a_ids, b_ids, groups, links)
        counts.update((a_ids[i], b_ids[j]) for i, j in links)
    highest = {}
    for (_, b_id), n in counts.items():
        highest[b_id] = max(n, highest.get(b_id, 0))
    found = {}
    for key, document in documents.items():
        if document is None:
            found[key] = (0,) * 7 + ("",)
            continue
        a_ids, b_ids, groups, links = document
        pairs = [(a_ids[i], b_ids[j]) for i, j in links]
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        found[key] = (
            len(a_ids),
            len(b_ids),
            len(groups),
            len(links),
            sum(counts[p] == highest[p[1]] for p in pairs),
            sum(counts[p] for p in pairs),
            sum(len(x) * len(y) for x, y in groups),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def measured(rows):
    return {r["doc_id"]: tuple(r[n] for n in NAMES) + (r["groups_sha256"],) for r in rows}


@pytest.mark.parametrize("block_bytes", [200, 1 << 22])
def test_equals_nested_loops(spark, libraries, block_bytes):
    rng = random.Random(block_bytes)
    texts = [(k, odd_text(rng, rng.randrange(0, 60))) for k in range(60)] + [(100, prose(rng, 80)), (101, None), (102, ""), (103, "a ▁b")]
    found = ta.align(frame(spark, texts).repartition(3), PAIR, block_bytes).collect()
    assert len(found) == len(texts)
    assert measured(found) == direct(texts, libraries)


def test_parts_equal_whole_texts(libraries):
    a, b = PAIR.load()
    rng = random.Random(7)
    for _ in range(400):
        text = odd_text(rng, 40)
        assert a.encode(text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert b.encode(text).tolist() == libraries[1].encode(text), text


def test_products_in_runs_of_any_size():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(1, 6, rng.integers(1, 40))
        b = rng.integers(1, 6, rng.integers(1, 40))
        short = a.sum() - b.sum()
        a, b = (a, np.append(b, short)) if short > 0 else (np.append(a, -short), b) if short < 0 else (a, b)
        dense = [np.zeros((len(x), x.sum()), int) for x in (a, b)]
        for matrix, sizes in zip(dense, (a, b)):
            ends = np.cumsum(sizes)
            for r, (s, e) in enumerate(zip(ends - sizes, ends)):
                matrix[r, s:e] = 1
        product = dense[0] @ dense[1].T
        for most in (1, 10, 1000):
            found = np.zeros_like(product)
            for i, j, shared in ta.overlap_links(a, b, most):
                found[i, j] += shared
            assert (found == product).all()
            groups = ta.group_ends(np.cumsum(a), np.cumsum(b))
            same = np.searchsorted(groups, np.cumsum(a))[:, None] == np.searchsorted(groups, np.cumsum(b))[None, :]
            found = np.zeros_like(product)
            for i, j, _ in ta.group_links(a, b, most):
                found[i, j] += 1
            assert (found == same).all()


def test_link_rows(spark):
    texts = [(1, "an unbelievable thing"), (None, "é!"), (2, None)]
    for kind in ("overlap", "group"):
        rows = ta.links(frame(spark, texts), PAIR, kind).collect()
        per = Counter(r["doc_id"] for r in rows)
        wanted = {r["doc_id"]: r["n_links" if kind == "overlap" else "n_group_links"] for r in ta.align(frame(spark, texts), PAIR).collect()}
        assert {k: per.get(k, 0) for k in wanted} == wanted
    with pytest.raises(ValueError):
        ta.links(frame(spark, texts), PAIR, "other")


def test_awkward_rows(spark, libraries):
    rows = [(None, "some words"), (1, "same"), (1, "other"), (1, "other"), (None, None)]
    found = ta.align(frame(spark, rows), PAIR).collect()
    wanted = direct([((k, i), t) for k, (i, t) in enumerate(rows)], libraries)
    as_rows = sorted((str(i), *values) for (_, i), values in wanted.items())
    assert sorted((str(r["doc_id"]), *(r[n] for n in NAMES), r["groups_sha256"]) for r in found) == as_rows


def weight(row):
    return sum(len(v) if isinstance(v, (bytes, bytearray, str)) else 8 * len(v) if isinstance(v, list) else 8 for v in row)


def test_rows_do_not_grow_with_their_block(spark):
    """What is staged and shuffled has rows of a document's size: a block of 4 MB as one row
    weighs many times its size in the executors."""
    rng = random.Random(11)
    texts = [(k, prose(rng, 300)) for k in range(400)]
    alone = max(weight(r) for r in ta.blocks(frame(spark, texts[:1]), PAIR).collect())
    together = max(weight(r) for r in ta.blocks(frame(spark, texts).coalesce(1), PAIR).collect())
    assert together < 3 * alone


def test_work_arrays_do_not_grow_with_the_block():
    tokens = PAIR.load()
    rng = random.Random(12)
    peaks = []
    for n in (300, 2400):
        texts = pa.array([prose(rng, 300) for _ in range(n)])
        docs = pa.RecordBatch.from_arrays([pa.array(range(n)), texts], names=["doc_id", "text"])
        tracemalloc.start()
        for _ in ta._block_rows(0, docs, tokens, ta._names(tokens)):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


def test_many_pairs_and_many_links(spark):
    """More pairs in a block than 16 bits tell apart, a text of several runs, and a pair with
    more links in one text than 16 bits count."""
    tokens = PAIR.load()
    rng = random.Random(13)
    pieces = [tokens[side].spell(np.array([k])).tobytes().decode("utf-8", "ignore") for side in (0, 1) for k in range(tokens[side].count)]
    texts = [(1, "".join(rng.choices(pieces, k=150_000))), (2, "word " * 70_000), (3, None), (4, "some words")]
    links = {}
    for key, text in texts:
        ids = ta.tokenise(text, *tokens)
        links[key] = Counter()
        for i, j, _ in ta.overlap_links(*(t.sizes[x] for t, x in zip(tokens, ids))):
            links[key].update(zip(ids[0][i].tolist(), ids[1][j].tolist()))
    counts = sum(links.values(), Counter())
    highest = {}
    for (_, b_id), n in counts.items():
        highest[b_id] = max(n, highest.get(b_id, 0))
    assert len(counts) > 1 << 16 and max(links[2].values()) > 1 << 16
    wanted = {
        key: (
            own.total(),
            sum(n for p, n in own.items() if counts[p] == highest[p[1]]),
            sum(n * counts[p] for p, n in own.items()),
        )
        for key, own in links.items()
    }
    found = ta.align(frame(spark, texts).coalesce(1), PAIR).collect()
    assert {r["doc_id"]: (r["n_links"], r["n_best"], r["count_sum"]) for r in found} == wanted


def test_groups_are_numbered_through_a_block(spark):
    """However a block is cut into stretches; a text longer than one is one of its own."""
    rng = random.Random(14)
    texts = [(1, prose(rng, 20)), (2, None), (3, "word " * 110_000), (4, prose(rng, 20)), (5, "")]
    per = {r["doc_id"]: r["n_groups"] for r in ta.align(frame(spark, texts).coalesce(1), PAIR).collect()}
    seen = {k: set() for k in per}
    for r in ta.links(frame(spark, texts).coalesce(1), PAIR, "group").select("doc_id", "value").distinct().collect():
        seen[r["doc_id"]].add(r["value"])
    first = 0
    for key, _ in texts:
        assert seen[key] == set(range(first, first + per[key]))
        first += per[key]


def test_empty_tables(spark):
    assert ta.align(spark.createDataFrame([], SCHEMA), PAIR).count() == 0
    only_empty = ta.align(frame(spark, [(1, None), (2, "")]), PAIR).collect()
    assert measured(only_empty) == {k: (0,) * 7 + ("",) for k in (1, 2)}


def test_query_on_supplied_documents(spark, libraries):
    from repoloom.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("supplied tables not present")
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    short = [(k, t) for k, t in texts if len(t or "") < 6000]
    assert measured(queries.op12_token_alignment(spark, folder).collect()).keys() == dict(texts).keys()
    assert measured(ta.align(frame(spark, short), PAIR).collect()) == direct(short, libraries)
