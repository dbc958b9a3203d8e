"""Words, hashes and shingles against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from repoloom.llm import textbytes

TEXT = st.text(alphabet=st.sampled_from(list("aB9 é\n\t\x0b\x1c -_中")), max_size=40)


def joined(texts):
    column = pa.array(texts, pa.string())
    return textbytes.text_buffers(column)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=8))
def test_words_match_the_patterns(texts):
    data, offsets = joined(texts)
    for table, pattern in (
        (textbytes.SPACE_WORDS, r"[^\x20\x09-\x0D]+"),
        (textbytes.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        low = textbytes.lowered(data)
        words = textbytes.find_words(low, offsets, table)
        raw = low.tobytes()
        for i, text in enumerate(texts):
            lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
            own = [raw[a:b].decode() for a, b in zip(words.starts[words.first[i] : words.first[i + 1]], words.ends[words.first[i] : words.first[i + 1]])]
            assert own == re.findall(pattern, lowered)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_equal_words_have_equal_hashes(texts):
    data, offsets = joined(texts)
    words = textbytes.find_words(data, offsets, textbytes.SPACE_WORDS)
    raw = data.tobytes()
    names = [raw[a:b] for a, b in zip(words.starts, words.ends)]
    hashes = words.hashes().tolist()
    assert len(set(names)) == len(set(hashes)) == len(set(zip(names, hashes)))


def test_slices_keep_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 50, None, "", "b" * 5, "c" * 500, "d"])], names=["i", "text"])
    seen = [
        (row, data[offsets[k] : offsets[k + 1]].tobytes().decode())
        for part, data, offsets in textbytes.slices(batch, "text", 60)
        for k, row in enumerate(part.column("i").to_pylist())
    ]
    assert seen == [(0, "a" * 50), (1, ""), (2, ""), (3, "b" * 5), (4, "c" * 500), (5, "d")]


def test_sequence_hashes_depend_on_content_only():
    values = textbytes.mix(np.array([1, 2, 3, 9, 1, 2, 3], dtype=np.uint64))
    one, two, other = textbytes.sequence_hashes(values, np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert one == two != other
