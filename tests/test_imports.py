"""Statement extraction against the standard library and by hand."""

import random
import re
import time

import pytest
from helpers import all_edges
from pyspark.sql import functions as F

from repoloom.operators import imports
from repoloom.settings import Settings

# --- Fixed values: statement patterns, as expected values -------------------
JS = [r"""(?:import|export)\s+.*?from\s+['"](\.[^'"]+)['"]""", r"""require\(\s*['"](\.[^'"]+)['"]\s*\)"""]
C = [r'#include\s+"([^"]+)"']
RUST = [r"use\s+crate::(\w+)"]
# --- End of fixed values ----------------------------------------------------

PIECES = [
    "import", "export", "from", "require(", ")", "'", '"', "./", "..", "a", " ", "\n", "\u00a0", "\u0085",
    "\u2028", "\x1c", "\x1f", "{x}", "*", "#include", '"b.h"', "'./m'", '"./m"', "use", "crate::", "é", "e\u0301",
    "_x1", "²", "\t", "\x0b", "::", "('./k')", "from './q'", "use crate::é", "#include \"c.h\"", "\ufeff", "\u200b",
]


@pytest.mark.parametrize(
    "column, patterns",
    [(imports.javascript_targets, JS), (imports.c_targets, C), (imports.rust_targets, RUST)],
)
def test_patterns_find_the_same(spark, column, patterns):
    pick = random.Random(5)
    cases = ["".join(pick.choices(PIECES, k=pick.randint(1, 25))) for _ in range(4000)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    got = [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]
    expected = [[m.group(1) for p in patterns for m in re.finditer(p, c)] for c in cases]
    assert got == expected
    assert sum(map(len, expected)) > 50


JS_PIECES = ["import", "export", " ", "  ", "\n", "\t\n", "from", "from './a'", "from\n'./b'", ";", "x", "'./c'", "'", "\u2028", "\x0b", "import\n", "export \n "]


def test_starts_on_one_line(spark):
    pick = random.Random(9)
    cases = ["".join(pick.choices(JS_PIECES, k=pick.randint(1, 18))) for _ in range(6000)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    got = [r["o"] for r in df.select("i", imports.javascript_targets(F.col("v")).alias("o")).orderBy("i").collect()]
    expected = [[m.group(1) for p in JS for m in re.finditer(p, c)] for c in cases]
    assert got == expected
    assert sum(map(len, expected)) > 500


@pytest.mark.parametrize("piece", ["import a;export b;", "import from ", "import " + " " * 50, "require( ", "from './x "])
def test_long_lines_take_linear_time(spark, piece):
    text = piece * (5_000_000 // len(piece))
    df = spark.range(1).select(F.lit(1).alias("i")).withColumn("v", F.expr(f"repeat({piece!r}, {len(text) // len(piece)})" if "'" not in piece else f'repeat("{piece}", {len(text) // len(piece)})'))
    begin = time.time()
    df.select(F.size(imports.javascript_targets(F.col("v")))).collect()
    assert time.time() - begin < 20


def as_files(spark, sources, language):
    rows = [(i, f"f{i}", language, s is not None, s) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "i int, path string, language string, readable boolean, text string")


def modules(spark, *sources):
    rows = imports.with_imports(as_files(spark, sources, "python")).orderBy("i").collect()
    return [None if r["modules"] is None else sorted((m["module"], m["level"]) for m in r["modules"]) for r in rows]


def test_text_never_waits_for_python(spark):
    """No column of whole texts passes the Python step, but for Python source."""
    from helpers import files
    from repoloom.operators import files as file_ops

    facts = file_ops.file_facts(files(spark, {"r": {"a.py": "import b", "b.js": "x"}}), Settings())
    plan = facts._jdf.queryExecution().executedPlan().toString()
    step = next(line for line in plan.split("\n") if "MapInArrow" in line)
    names = set(re.findall(r"(\w+)#\d+", step))
    assert "python_text" in names and not names & {"text", "content"}


def test_python_forms(spark):
    source = """
import a.b, c as d
from m import x, y
from . import here
from ..up.more import z
def f():
    if True:
        import nested
"""
    assert modules(spark, source) == [[("", 1), ("a.b", 0), ("c", 0), ("m", 0), ("nested", 0), ("up.more", 2)]]


def test_python_without_a_parse(spark):
    got = modules(spark, "import (", "import a\0", "\ufeffimport a", "", None, "x = '\\d'\nimport w")
    assert got == [[], [], [], [], None, [("w", 0)]]


def test_python_parser_exhaustion_is_reported(spark):
    deep = "import a\nx = " + "-" * 200_000 + "1"
    row = imports.with_imports(as_files(spark, [deep], "python")).first()
    assert row["failure"] and row["modules"] == []


CASES = {
    # The brace form spans lines, so nothing between `import` and `from` matches.
    "javascript forms": (
        {"a/b.ts": "import {\n x\n} from './p'\nimport './q'\nimport y from '.'\nimport z from '..'\nimport('./d')"},
        {("a/b.ts", "."): 1},
    ),
    "c and rust forms": (
        {"a.c": '#include"b.h"\n#include <d.h>\n# include "c.h"', "b.rs": "use crate::{a,b};\nuse std::c;"},
        {},
    ),
    "require and from add up": (
        {"x/a.js": "import q from './t'\nconst q = require('./t')\nexport * from \"../t\""},
        {("x/a.js", "x/t"): 2, ("x/a.js", "t"): 1},
    ),
    "absolute include and climbing out": (
        {"a.c": '#include "/usr/x.h"\n#include "../../y.h"'},
        {("a.c", "/usr/x.h"): 1, ("a.c", "../../y.h"): 1},
    ),
    "package wins over module": (
        {"p.py": "", "p/__init__.py": "", "q.py": "import p"}, {("q.py", "p/__init__.py"): 1},
    ),
    "from-import looks at the module only": ({"q.py": "from p import m", "p/m.py": ""}, {}),
    "longest prefix": (
        {"a/__init__.py": "", "a/b.py": "", "q.py": "import a.b.c.d\nimport a.x\nimport a\nimport ab"},
        {("q.py", "a/b.py"): 1, ("q.py", "a/__init__.py"): 2},
    ),
    "every occurrence counts": (
        {"q.py": "import b\nimport b\ndef f():\n    import b.c\n    from b import d", "b.py": ""},
        {("q.py", "b.py"): 4},
    ),
    "a Python file does not point at itself": ({"a.py": "import a\nimport a.b"}, {}),
    "upper-case suffix imports but is no module": (
        {"a.PY": "import b", "b.py": "import a"}, {("a.PY", "b.py"): 1},
    ),
    "top-level package marker is no module": ({"__init__.py": "", "q.py": "import __init__"}, {}),
    "pruned folders do not import": (
        {"a.c": '#include "data/x.h"', "data/x.h": '#include "y.h"'}, {("a.c", "data/x.h"): 1},
    ),
    "names stay within their repository": ({"q.py": "import elsewhere"}, {}),
    "another repository": ({"elsewhere.py": ""}, {}),
}

RELATIVE = {
    "siblings": (
        {"p/a.py": "from .b import x\nfrom . import c", "p/b.py": ""}, {("p/a.py", "p/b.py"): 1},
    ),
    "levels": (
        {"p/q/a.py": "from ..b import x\nfrom .. import y\nfrom ....z import w", "p/b.py": "",
         "p/__init__.py": "", "z.py": ""},
        {("p/q/a.py", "p/b.py"): 1, ("p/q/a.py", "p/__init__.py"): 1},
    ),
    "top": ({"a.py": "from .b import x\nfrom . import y", "b.py": "", "__init__.py": ""}, {("a.py", "b.py"): 1}),
}


@pytest.fixture(scope="module")
def found(spark):
    return all_edges(spark, {name: tree for name, (tree, _) in {**CASES, **RELATIVE}.items()})


@pytest.mark.parametrize("name", list(CASES))
def test_edges(found, name):
    assert found[name] == CASES[name][1]


@pytest.mark.parametrize("name", list(RELATIVE))
def test_relative_imports_are_dropped_by_default(found, name):
    assert found[name] == {}


def test_relative_imports_can_be_followed(spark):
    follow = Settings(relative_imports="resolve")
    trees = {name: tree for name, (tree, _) in RELATIVE.items()}
    assert all_edges(spark, trees, follow) == {name: edges for name, (_, edges) in RELATIVE.items()}
