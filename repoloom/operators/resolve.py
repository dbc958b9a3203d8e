"""From import statements to edges between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import paths
from repoloom.settings import Settings
from repoloom.sources.staging import Staging


def module_index(files: DataFrame) -> DataFrame:
    """(repo_id, module, path): the file a dotted name stands for.

    If several files share a name the deepest wins, so a package beats the
    module of the same name; equal depths fall back to the greater path.
    """
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    return (
        files.select("repo_id", "path", paths.module_name(F.col("path")).alias("module"), depth.alias("depth"))
        .filter(F.col("module").isNotNull())
        .groupBy("repo_id", "module")
        .agg(F.max(F.struct("depth", "path")).getField("path").alias("path"))
    )


def absolute_name(module: Column, level: Column, directory: Column, relative: str) -> Column:
    """Dotted name to look up; NULL for a relative import that is not followed."""
    if relative == "drop":
        return F.when(level == 0, module)
    folders = F.when(directory == "", F.array().cast("array<string>")).otherwise(
        F.split(directory, "/")
    )
    kept = F.size(folders) - (level - 1)
    base = F.when(kept >= 0, F.slice(folders, F.lit(1), F.greatest(kept, F.lit(0))))
    tail = F.when(module == "", F.array().cast("array<string>")).otherwise(F.array(module))
    followed = F.nullif(F.array_join(F.concat(base, tail), "."), F.lit(""))
    return F.when(level == 0, module).otherwise(followed)


def _parts(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def with_dotted_prefixes(names: DataFrame, most: Column | None = None) -> DataFrame:
    """A row per prefix `module` of `name`: `a.b.c` gives `a`, `a.b` and `a.b.c`; none of
    more than `most` parts."""
    parts = _parts(F.col("name"))
    longest = parts if most is None else F.least(parts, most)
    # Cut to the longest prefix first, so that no prefix costs more than that one.
    cut = F.call_function("substring_index", F.col("name"), F.lit("."), longest)
    counted = names.withColumns({"module": cut, "parts": F.explode(F.sequence(F.lit(1), longest))})
    prefix = F.call_function("substring_index", F.col("module"), F.lit("."), F.col("parts"))
    return counted.withColumn("module", prefix).select(*names.columns, "module")


def python_occurrences(facts: DataFrame, relative: str) -> DataFrame:
    """(repo_id, path, name), a row per occurrence of a dotted name in a file."""
    exploded = facts.filter(F.col("language") == "python").select(
        "repo_id", "path", "directory", F.explode("modules").alias("m")
    )
    name = absolute_name(F.col("m.module"), F.col("m.level"), F.col("directory"), relative)
    return exploded.select("repo_id", "path", name.alias("name")).filter(F.col("name").isNotNull())


def longest_prefix_targets(names: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_id, name, dst): the indexed file of the longest prefix of each name.

    Equality on exploded prefixes instead of a condition on pairs, with no more prefixes
    than the repository's deepest module has parts, however long a name is; names without
    any indexed prefix (third-party modules) drop out in the join.
    """
    deepest = index.groupBy("repo_id").agg(F.max(_parts(F.col("module"))).alias("deepest"))
    bounded = names.select("repo_id", "name").join(deepest, "repo_id")
    return (
        with_dotted_prefixes(bounded, F.col("deepest"))
        .select("repo_id", "name", "module")
        .join(index, ["repo_id", "module"])
        .groupBy("repo_id", "name")
        .agg(F.max_by("path", F.length("module")).alias("dst"))
    )


def python_edges(
    facts: DataFrame, settings: Settings, staging: Staging | None = None
) -> DataFrame:
    """(repo_id, src, dst, n) of Python imports; a file never points at itself.

    Names are resolved once per repository, however many files import them: the
    distinct names collapse before their shuffle. With `staging` the resolved
    names are written down first. The join back then has a plain scan and
    shuffle on both sides, which lets the planner broadcast a small table and
    split a name that a huge share of all files imports.
    """
    occurrences = python_occurrences(facts, settings.relative_imports)
    index = module_index(facts.filter(F.col("language") == "python").select("repo_id", "path"))
    targets = longest_prefix_targets(occurrences.select("repo_id", "name").distinct(), index)
    if staging is not None:
        targets = staging.save(targets, "import-targets").df
    return (
        occurrences.join(targets, ["repo_id", "name"])
        .filter(F.col("path") != F.col("dst"))
        .groupBy("repo_id", F.col("path").alias("src"), "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def path_edges(facts: DataFrame) -> DataFrame:
    """(repo_id, src, dst, n) of JavaScript, C and Rust imports.

    JavaScript and C targets are paths from the importing folder, taken as
    written: no suffix is guessed and the file need not exist. A Rust target is
    the bare first name. A file may point at itself.
    """
    exploded = facts.filter(F.col("language").isin("javascript", "c", "rust")).select(
        "repo_id", F.col("path").alias("src"), "directory", "language",
        F.explode("targets").alias("target"),
    )
    located = paths.locate(F.col("directory"), F.col("target"))
    dst = F.when(F.col("language") == "rust", F.col("target")).otherwise(located)
    return (
        exploded.select("repo_id", "src", dst.alias("dst"))
        .groupBy("repo_id", "src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def all_edges(facts: DataFrame, settings: Settings, staging: Staging | None = None) -> DataFrame:
    """Edges of every language. A source file has one language, so the two
    branches never share an edge and need no further grouping."""
    return path_edges(facts).unionByName(python_edges(facts, settings, staging))
