"""Import statements per file, before resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: statement patterns ---------------------------------------
# Matches decide the graph, so the patterns must stay as they are. `_S` and `_W`
# spell out Unicode white space and word characters, and `(?d)` lets `.` stop
# only at "\n", because the JVM's shorthands cover other characters.
_S = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_W = r"[\p{L}\p{N}_]"
JS_FROM = rf"""(?d)(?:import|export){_S}+.*?from{_S}+['"](\.[^'"]+)['"]"""
JS_REQUIRE = rf"""(?d)require\({_S}*['"](\.[^'"]+)['"]{_S}*\)"""
C_INCLUDE = rf"""(?d)#include{_S}+"([^"]+)\""""
RUST_USE = rf"""(?d)use{_S}+crate::({_W}+)"""
# --- End of fixed values ----------------------------------------------------

# JS_FROM in linear time. A start without a target up to the end of its line takes the
# rest of the line, since no later start on that line can have one either, except for one at
# its very end, whose white space runs on to the next line. White space is taken whole.
_BLANK = _S.replace(r"\t-\r", r"\t\x0b-\r")
_LAST_START = rf"(?:import|export){_BLANK}*+\n"
JS_FROM_LINEAR = (
    rf"""(?d)(?:import|export){_S}++(?:.*?from{_S}++['"](\.[^'"]+)['"]|.*(?={_LAST_START})|.*+)"""
)


def javascript_targets(text: Column) -> Column:
    starts = F.regexp_extract_all(text, F.lit(JS_FROM_LINEAR), F.lit(1))
    return F.concat(
        F.filter(starts, lambda target: target != ""),
        F.regexp_extract_all(text, F.lit(JS_REQUIRE), F.lit(1)),
    )


def c_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C_INCLUDE), F.lit(1))


def rust_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUST_USE), F.lit(1))


MODULES = T.ArrayType(T.StructType().add("module", T.StringType()).add("level", T.IntegerType()))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace `python_text` by `modules` and `parse_failure`; other columns pass as they are.

    Python's grammar needs Python's parser. A file that is not valid Python has
    no imports; one that exhausts the parser reports a failure.
    """
    import ast
    import warnings

    module = pa.struct([("module", pa.string()), ("level", pa.int32())])

    def modules_of(source):
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.Import):
                yield from ((name.name, 0) for name in node.names)
            elif isinstance(node, ast.ImportFrom) and (node.module or node.level):
                yield node.module or "", node.level

    def row(source):
        if source is None:
            return None, None
        try:
            return list(modules_of(source)), None
        except (SyntaxError, ValueError):
            return [], None
        except (RecursionError, MemoryError) as problem:
            return [], str(problem) or type(problem).__name__

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for batch in batches:
            found = [row(source) for source in batch.column("python_text").to_pylist()]
            names = [name for name in batch.schema.names if name != "python_text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names]
                + [
                    pa.array([modules for modules, _ in found], pa.list_(module)),
                    pa.array([failure for _, failure in found], pa.string()),
                ],
                names=[*names, "modules", "parse_failure"],
            )


def with_imports(files: DataFrame) -> DataFrame:
    """Replace `text` by `targets` (JavaScript, C, Rust), `modules` (Python) and `failure`.

    Everything native is measured first: what goes to Python is Python source, and the
    text of other languages is gone by then.
    """
    lang, text = F.col("language"), F.col("text")
    native = files.select(
        *[c for c in files.columns if c != "text"],
        F.when(lang == "javascript", javascript_targets(text))
        .when(lang == "c", c_targets(text))
        .when(lang == "rust", rust_targets(text))
        .alias("targets"),
        F.when(lang == "python", text).alias("python_text"),
    )
    kept = [f for f in native.schema if f.name != "python_text"]
    shape = T.StructType(kept).add("modules", MODULES).add("parse_failure", T.StringType())
    parsed = native.mapInArrow(_parse_batches, shape)
    unreadable = F.when(
        (lang == "python") & ~F.col("readable"), F.concat(F.lit("unreadable file: "), "path")
    )
    return parsed.withColumn("failure", F.coalesce(unreadable, F.col("parse_failure"))).drop("parse_failure")
