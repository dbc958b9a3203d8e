"""Path arithmetic as Column expressions (relative POSIX paths)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.settings import LANGUAGE_EXTENSIONS, PRUNED_DIRECTORY_SUFFIX


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty at the top level."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.left(path, F.greatest(cut, F.lit(0)))


def extension(path: Column) -> Column:
    """Last dot suffix of the file name, lower-cased; leading dots do not count."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1))


def in_pruned_directory(path: Column, directories: Iterable[str]) -> Column:
    """True if any directory part (never the file name) is in the set."""
    names = "|".join(re.escape(d) for d in directories)
    suffix = re.escape(PRUNED_DIRECTORY_SUFFIX)
    return path.rlike(rf"(?:^|/)(?:{names}|[^/]*{suffix})/")


def language(ext: Column) -> Column:
    """Language whose imports are followed, NULL for all other files."""
    chosen = F.lit(None).cast("string")
    for name, extensions in LANGUAGE_EXTENSIONS.items():
        chosen = F.when(ext.isin(*extensions), F.lit(name)).otherwise(chosen)
    return chosen


def join(directory: Column, target: Column) -> Column:
    return F.when(target.startswith("/") | (directory == ""), target).otherwise(
        F.concat(directory, F.lit("/"), target)
    )


def normalize(path: Column) -> Column:
    """Collapse empty, `.` and `..` parts; `..` may climb above the top."""
    rooted = path.startswith("/")
    root = (
        F.when(path.rlike("^//(?!/)"), F.lit("//")).when(rooted, F.lit("/")).otherwise(F.lit(""))
    )
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        # An empty stack behaves as if its top were "..": nothing to step out of.
        top = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(".."))
        return F.when(
            (part == "..") & (top != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)
        ).otherwise(F.concat(kept, F.array(part)))

    def append(kept: Column, block: Column) -> Column:
        # Collapsed parts begin with their steps up, if any; names follow.
        up = F.size(F.filter(block, lambda p: p == ".."))
        names = F.size(F.filter(kept, lambda p: p != ".."))
        out = F.least(up, names)
        beyond = F.when(rooted, F.lit(0)).otherwise(up - out)
        return F.concat(
            F.slice(kept, F.lit(1), F.size(kept) - out),
            F.array_repeat(F.lit(".."), beyond),
            F.slice(block, up + 1, F.size(block) - up),
        )

    # Folding copies what has been kept for each part, hence blocks of about the square
    # root of the number of parts, collapsed on their own first.
    def collapse(parts: Column) -> Column:
        some = F.greatest(F.size(parts), F.lit(1))
        width = F.ceil(F.sqrt(some)).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((some - 1) / width).cast("int"))
        blocks = F.transform(numbers, lambda i: F.aggregate(F.slice(parts, i * width + 1, width), none, step))
        return F.aggregate(blocks, none, append)

    # Bound by transforming arrays of one, so that each is computed once.
    kept = F.get(F.transform(F.array(parts), collapse), F.lit(0))
    full = F.concat(root, F.array_join(kept, "/"))
    collapsed = F.coalesce(F.nullif(full, F.lit("")), F.lit("."))
    # Plain paths are the common case and skip the interpreted fold.
    untidy = (path == "") | path.rlike(r"(?:^|/)\.{0,2}(?:/|\z)")
    return F.when(untidy, collapsed).otherwise(path)


def locate(directory: Column, target: Column) -> Column:
    """`normalize(join(directory, target))`, cheap for the usual targets.

    Usual: an optional `./`, then any number of `../`, then plain names, from a
    tidy relative directory. Stepping up is then a matter of cutting the
    directory short; everything else takes the general way.
    """
    climb = F.regexp_extract(target, r"^(?:\./)?((?:\.\./)*+)", 1)
    names = F.regexp_replace(target, r"^(?:\./)?(?:\.\./)*+", "")
    # Tested by what must not occur: repeated groups would recurse once per part.
    usual = ~names.rlike(r"^[/.]|//|/\.|/\z|^\z") & ~directory.rlike(
        r"^/|(?:^|/)\.{1,2}(?:/|\z)|//|/\z"
    )
    up = (F.length(climb) / 3).cast("int")
    depth = F.when(directory == "", F.lit(0)).otherwise(
        F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit(""))) + 1
    )
    above = F.when(
        depth > up, F.concat(F.call_function("substring_index", directory, F.lit("/"), depth - up), F.lit("/"))
    ).otherwise(F.repeat(F.lit("../"), up - depth))
    return F.when(usual, F.concat(above, names)).otherwise(normalize(join(directory, target)))


def module_name(path: Column) -> Column:
    """Dotted module of a `.py` path; NULL if not one, or for a top-level `__init__.py`."""
    package = F.when(
        base_name(path) == "__init__.py", F.nullif(dir_name(path), F.lit(""))
    ).otherwise(F.left(path, F.length(path) - 3))
    return F.when(path.endswith(".py"), F.translate(package, "/", "."))
