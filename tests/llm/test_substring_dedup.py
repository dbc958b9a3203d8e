"""FM-index results against a search of all windows."""

import hashlib
import random

import numpy as np
import pytest

from repoloom.llm import substring_dedup
from repoloom.llm.fm_index import FmIndex, WaveletTree
from samples import frame, prose


def brute(rows, width):
    first = {}
    for i, text in rows:
        own = (text or "").split()
        for k in range(len(own) - width + 1):
            w = tuple(own[k : k + width])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    result = []
    for i, text in rows:
        own = (text or "").split()
        gone = set()
        for k in range(len(own) - width + 1):
            if i is not None and first[tuple(own[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        result.append((str(i), len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(result)


def case(width):
    rng = random.Random(6)
    passages = [prose(rng, rng.choice([width - 1, width, width + 7, 3 * width])) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randrange(1, 2 * width))]
        for _ in range(rng.choice([0, 1, 2])):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, width))]
        rows.append((k, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "is " * 300), (103, "is " * 250), (104, None), (105, ""), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,options", [(50, {}), (12, {"shard_words": 200}), (12, {"max_segments": 1}), (3, {"shard_words": 500})])
def test_removals_match_all_windows(spark, width, options):
    rows = case(width)
    found = substring_dedup.remove_repeats(frame(spark, rows), width, **options).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in found) == brute(rows, width)


@pytest.mark.parametrize("options", [{}, {"max_segments": 1, "shard_words": 50}])
def test_repeated_ids_and_rows(spark, options):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (40, 25, 60)]
    rows = [(5, texts[0]), (5, texts[1]), (5, None), (5, texts[0]), (5, texts[0]), (4, f"{texts[2]} {texts[1]}"), (4, "")]
    rows += [(6, f"{texts[0]} z {texts[1]}"), (6, texts[2]), (7, texts[2]), (7, texts[2]), (None, texts[0]), (None, texts[0])]
    found = substring_dedup.remove_repeats(frame(spark, rows), 12, **options).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in found) == brute(rows, 12)


def test_text_and_empty_table(spark):
    rows = [(1, "a b c d"), (2, "x a b c y")]
    found = substring_dedup.remove_repeats(frame(spark, rows), 3, with_text=True).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in found) == [(1, "a b c d"), (2, "x y")]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_rank_counts_occurrences():
    rng = np.random.default_rng(1)
    for n_symbols in (1, 2, 7, 64):
        symbols = rng.integers(0, n_symbols, 300)
        tree = WaveletTree(symbols, n_symbols)
        at = rng.integers(0, 301, 200)
        asked = rng.integers(0, n_symbols, 200)
        assert tree.rank(asked, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(asked, at)]


def test_index_refuses_what_it_lacks():
    words = np.array([1, 2, 3], dtype=np.uint64)
    index = FmIndex(words, np.array([3]), np.array([5]), 2)
    assert index.stream(words, np.array([3])).tolist() == [5, 5, -1]
    with pytest.raises(ValueError):
        index.stream(np.array([2, 1], dtype=np.uint64), np.array([2]))
