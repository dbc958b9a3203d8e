"""Column functions against the standard library."""

import posixpath
import time
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repoloom.functions import numbers, paths, text, tokens
from repoloom.settings import (
    COUNTED_EXTENSIONS,
    DENIED_EXTENSIONS,
    PRUNED_DIRECTORIES,
)


def evaluate(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_fixed_sets():
    assert (len(COUNTED_EXTENSIONS), len(DENIED_EXTENSIONS), len(PRUNED_DIRECTORIES)) == (69, 56, 29)
    assert not set(COUNTED_EXTENSIONS) & set(DENIED_EXTENSIONS)


@pytest.mark.parametrize(
    "name, expected",
    [(".env", ""), ("..py", ""), ("a.R", ".r"), ("Dockerfile", ""), ("x.dockerfile", ".dockerfile"),
     ("foo.", "."), ("a.tar.gz", ".gz"), ("d.x/file", ""), ("", "")],
)
def test_extension(spark, name, expected):
    assert evaluate(spark, [name], paths.extension) == [expected]


def test_path_parts_like_posixpath(spark):
    pick = random.Random(1)
    names = ["/".join("".join(pick.choices("aB._", k=pick.randint(1, 4))) for _ in range(pick.randint(1, 4)))
             for _ in range(500)]
    assert evaluate(spark, names, paths.base_name) == [posixpath.basename(n) for n in names]
    assert evaluate(spark, names, paths.dir_name) == [posixpath.dirname(n) for n in names]
    assert evaluate(spark, names, paths.extension) == [
        posixpath.splitext(posixpath.basename(n))[1].lower() for n in names
    ]


def test_normalize_like_posixpath(spark):
    pick = random.Random(2)
    pieces = ["..", ".", "", "a", "b.c", "..d", ".e", "f "]
    cases = ["/".join(pick.choices(pieces, k=pick.randint(1, 7))) for _ in range(1500)]
    cases += ["../x", "x", "//usr/x", "///u", "..", "", "/", "//", "/..", "./", "a/..", "a/../.."]
    assert evaluate(spark, cases, paths.normalize) == [posixpath.normpath(c) for c in cases]


def test_locate_like_posixpath(spark):
    pick = random.Random(3)
    pieces = ["..", ".", "", "a", "b.c", "..d", ".e", "é"]
    folders = ["", "src", "src/core", "a/b/c", "../out", "x/../y", "/abs", "a//b", "a/", ".h/i", "a.b/c"]
    cases = []
    for _ in range(3000):
        target = "/".join(pick.choices(pieces, k=pick.randint(1, 6)))
        cases.append((pick.choice(folders), pick.choice(["./", "../", "../../", ""]) + target))
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(cases)], "i int, d string, t string")
    got = [r[0] for r in df.select("i", paths.locate(F.col("d"), F.col("t")).alias("o"))
           .orderBy("i").select("o").collect()]
    assert got == [posixpath.normpath(posixpath.join(d, t)) for d, t in cases]


def test_pruned_directories(spark):
    cases = {
        "node_modules/a.js": True, "a/node_modules/b/c.js": True, "node_modules": False,
        "my_node_modules/a.js": False, "x.egg-info/a": True, "a/.egg-info/b": True,
        "egg-info/a": True, "Data/a.py": False, "data/a.py": True, "a/data": False,
        "xgit/a": False, ".git/config": True, "venvs/a": False,
    }
    got = evaluate(spark, list(cases), lambda c: paths.in_pruned_directory(c, PRUNED_DIRECTORIES))
    assert dict(zip(cases, got)) == cases


def test_module_names(spark):
    cases = {"a/b.py": "a.b", "a/__init__.py": "a", "__init__.py": None, "b.py": "b", "B.PY": None,
             "a.b/c.py": "a.b.c", "x__init__.py": "x__init__", "a/b.pyi": None}
    assert dict(zip(cases, evaluate(spark, list(cases), paths.module_name))) == cases


def test_decode_drops_invalid_bytes(spark):
    pick = random.Random(4)
    cases = [bytes(pick.choices([0x41, 0x0A, 0x0D, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90,
                                 0xF4, 0x8F, 0xFF, 0xC0, 0xE2, 0x82, 0xAC], k=pick.randint(0, 12)))
             for _ in range(1500)]
    cases += ["ok \ufffd kept\r\n\rend".encode(), b"\xef\xbb\xbfbom", "žluť €\U0001f600".encode() + b"\xff", b""]
    expected = [c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in cases]
    assert evaluate(spark, [bytearray(c) for c in cases], text.decode_lenient, "binary") == expected


def test_decode_long_invalid_text(spark):
    content = b"\xff" + "line of text é\r\n".encode() * 60_000
    got = evaluate(spark, [bytearray(content)], lambda c: F.length(text.decode_lenient(c)), "binary")
    assert got == [len("line of text é\n") * 60_000]


def test_rounding_is_exact(spark):
    ratios = [a / b for b in (3, 7, 16, 32, 160, 800, 4000, 20000) for a in range(0, 3 * b, max(1, b // 97))]
    ratios += [0.66665, 1 / 32, 3 / 32, 1234567.00005, 2.5e-5, 0.00005, 5e-7, 1e-12, 0.0]
    for places in (4, 6, 9):
        assert evaluate(spark, ratios, lambda c: numbers.round_exact(c, places), "double") == [
            round(r, places) for r in ratios
        ]


def test_builtin_tokens_agree(spark):
    cases = ["", "  \n", "a", "foo_bar(12345, 'é');", "x\u00a0y", "日本語 text 3.14159", "\u2003", "a\tb\x0bc"]
    counts = evaluate(spark, cases, tokens.count_tokens)
    lists = evaluate(spark, cases, tokens.token_list)
    assert counts == [len(x) for x in lists]
    assert lists[3] == ["foo", "_", "bar", "(", "123", "45", ",", "'", "é", "');"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
def test_builtin_counts_match_lists_on_any_text(spark, cases):
    cases = [c.encode("utf-8", "ignore").decode() for c in cases]
    assert evaluate(spark, cases, tokens.count_tokens) == [
        len(x) for x in evaluate(spark, cases, tokens.token_list)
    ]


def byte_encoder():
    """A loader of a tiny encoder: single bytes plus one merge."""

    def load():
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)}
        ranks[b"ab"] = 256
        return tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks,
                                 special_tokens={"<|end|>": 257})

    return load


def test_exact_counter_and_ids(spark):
    count = tokens.encoder_counter(byte_encoder())
    assert evaluate(spark, ["abc", "", None, "<|end|>", "é"], count) == [2, 0, None, 7, 2]
    ids = tokens.encoder_tokens(byte_encoder(), 3)
    assert evaluate(spark, ["abcab", "", None], ids) == [[256, 99, 256], [], None]


@pytest.mark.parametrize("shapes, n", [(["a/", "../", "./"], 200_000), (["a/../", "a//", "../a/"], 20_000)])
def test_deep_targets(spark, shapes, n):
    """Neither recursion nor copying per part; targets that need folding take longer."""
    cases = [shape * n + "b" for shape in shapes] + ["a/" * n + "../" * (n // 2) + "b"] * (n < 100_000)
    begin = time.time()
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.select("i", paths.locate(F.lit("x/y"), F.col("t")).alias("o")).orderBy("i").select("o").collect()]
    assert got == [posixpath.normpath("x/y/" + c) for c in cases]
    assert time.time() - begin < 60
