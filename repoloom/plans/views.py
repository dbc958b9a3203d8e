"""Input contracts derived from the supplied star-schema tables.

Every view is a row-by-row projection (or one join) of whole tables, so it
grows with them and needs no grouping. FIXTURES.md gives the formulas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom import schemas

ORDERS_PER_REPO = 150
HOT_REPO = 2
FOLDERS = ("src", "src/core", "lib", "data", "")
SUFFIXES = (".py", ".ts", ".h", ".rs")
LANGUAGES = ("python", "javascript", "c", "rust")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values) -> Column:
    pairs = list(enumerate(values))
    last = F.lit(pairs[-1][1])
    return reduce(lambda rest, p: F.when(index == p[0], F.lit(p[1])).otherwise(rest), pairs[-2::-1], last)


# --- Repositories, metadata, snapshots: one per supplier ---------------------


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    slug = _slug()
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        _repo_id(k).alias("id"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("")).otherwise(slug).alias("full_name"),
        F.when(k % 10 != 0, F.concat(F.lit("https://github.com/"), slug)).alias("url"),
        F.col("n_name").alias("conference"),
        (F.lit(2018) + k % 8).cast("int").alias("year"),
        F.col("s_name").alias("paper_title"),
    )
    return schemas.conform(rows, schemas.REPOS)


def _slug() -> Column:
    return F.concat(F.lit("org"), F.col("s_nationkey"), F.lit("/p"), F.col("s_suppkey"))


def _repo_id(k: Column) -> Column:
    return F.concat(F.lit("r"), k.cast("string"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harvested lookups; every third name also has an older row of size 0, every
    seventeenth lookup failed."""
    k = F.col("s_suppkey")
    kept = table(spark, sf_dir, "supplier").filter(k % 11 != 0)
    ages = F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = kept.select(
        _slug().alias("full_name"),
        F.floor(F.abs("s_acctbal") / 20).cast("bigint").alias("whole_size"),
        _pick(k % 4, ("Python", "TypeScript", "C", None)).alias("language"),
        F.when(k % 6 != 0, F.lit("trunk")).alias("default_branch"),
        F.when(k % 17 == 5, F.lit(404)).otherwise(F.lit(200)).alias("http_status"),
        F.explode(ages).alias("age"),
    ).select(
        "full_name",
        (F.col("whole_size") * F.col("age")).alias("size_kb"),
        "language",
        "default_branch",
        "http_status",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("age")).alias("fetched_at"),
    )
    return schemas.conform(rows, schemas.METADATA)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth repository has a failed attempt beside its last one."""
    k = F.col("s_suppkey")
    taken = k % 13 != 0
    attempts = F.when(k % 6 == 0, F.array(F.lit(False), taken)).otherwise(F.array(taken))
    rows = table(spark, sf_dir, "supplier").select(
        _repo_id(k).alias("repo_id"), F.explode(attempts).alias("ok")
    )
    return schemas.conform(rows, schemas.SNAPSHOTS)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an earlier run: every third repository, of two different outcomes."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(k % 3 == 0).select(
        _repo_id(k).alias("repo_id"),
        F.when(k % 2 == 0, F.lit("completed")).otherwise(F.lit("clone_failed")).alias("processing_status"),
    )


# --- Code files: one per order ------------------------------------------------


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file per order, with one to seven import statements.

    Orders are spread over repositories in blocks, and every third one falls to
    a single repository, so that one repository holds a third of everything.
    """
    k = F.col("o_orderkey")
    block = F.expr(f"o_orderkey div {ORDERS_PER_REPO}")
    hot = (k % 3 == 0) | (block == HOT_REPO)
    x, language = F.col("x"), F.col("x") % 4
    unreadable = ~F.col("hot") & (x % ORDERS_PER_REPO == 16) & (F.col("repo") % 7 == 4)
    rows = (
        # Keys only: text is made from them after this.
        table(spark, sf_dir, "orders")
        .select("o_orderkey")
        .repartition(spark.sparkContext.defaultParallelism)
        .select(
            k.alias("x"),
            hot.alias("hot"),
            F.when(hot, F.lit(HOT_REPO)).otherwise(block).alias("repo"),
        )
        .select(
            "x",
            "repo",
            unreadable.alias("unreadable"),
            F.slice(F.array(*[_target(j) for j in range(1, 8)]), F.lit(1), (x % 7 + 1).cast("int")).alias(
                "targets"
            ),
            (language == 0).alias("python"),
            _pick(
                language, ("import ", "import x from './", '#include "../lib/', "use crate::")
            ).alias("before"),
            _pick(language, ("", "'", '.h"', "::f;")).alias("after"),
            _pick(
                language, ("from .", "const y = require('../", '#include "../lib/', "use crate::")
            ).alias("last_before"),
            _pick(language, (" import x", "')", '.h"', "::f;")).alias("last_after"),
        )
        .select(
            "x", "repo", "unreadable",
            F.array_join(F.transform("targets", _statement), "\n").alias("code"),
        )
        .select(
            _repo_id(F.col("repo")).alias("repo_id"),
            _code_path(x).alias("path"),
            F.octet_length("code").cast("bigint").alias("size_bytes"),
            F.when(~F.col("unreadable"), F.col("code").cast("binary")).alias("content"),
        )
    )
    return schemas.conform(_made_once(rows, "path"), schemas.FILES)


def _made_once(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with all columns as they are, below which no filter sinks.

    The planner would move a filter on paths or sizes in front of the dealing of keys, and make
    every text there once more, in as many tasks as the keys have files. It leaves filters above
    a column that is not deterministic; this one's condition always holds.
    """
    return rows.withColumn(column, F.when(F.spark_partition_id() >= 0, F.col(column)))


def _code_path(x: Column) -> Column:
    folder = _pick(x % 5, [d + "/" if d else "" for d in FOLDERS])
    return F.concat(folder, F.lit("m"), x.cast("string"), _pick(x % 4, SUFFIXES))


def _target(j: int) -> Column:
    """Number of the file that statement `j` of file `x` points at."""
    jump = (j * j + j // 7) % 11
    inside = F.expr(
        f"repo * {ORDERS_PER_REPO} + (x - repo * {ORDERS_PER_REPO}) div 2 + {2 * jump}"
    )
    return F.when(F.col("hot"), F.expr(f"(x div 6 + {jump}) * 3")).otherwise(inside)


def _statement(target: Column, index: Column) -> Column:
    """One statement in the file's language; the second and the seventh differ in form."""
    name = F.concat(F.lit("m"), target.cast("string"))
    packages = F.array(*[F.lit(d.replace("/", ".") + "." if d else "") for d in FOLDERS])
    package = F.when(
        F.col("python"), F.element_at(packages, (target % 5 + 1).cast("int"))
    ).otherwise(F.lit(""))
    attribute = F.when(F.col("python") & (index == 1), F.lit(".attr")).otherwise(F.lit(""))
    plain = F.concat("before", package, name, "after", attribute)
    return F.when(index == 6, F.concat("last_before", name, "last_after")).otherwise(plain)


# --- Documents as files ---------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    n = i.cast("string")
    path = (
        F.when(i % 7 == 0, F.concat(F.lit("src/"), n, F.lit(".py")))
        .when(i % 7 == 1, F.concat(F.lit("docs/"), n, F.lit(".md")))
        .when(i % 7 == 2, F.concat(F.lit("tab/"), n, F.lit(".csv")))
        .when(i % 7 == 3, F.concat(F.lit("R/"), n, F.lit(".R")))
        .when(i % 7 == 4, F.concat(F.lit("node_modules/"), n, F.lit(".js")))
        .when(i % 7 == 5, F.concat(F.lit("x.egg-info/"), n, F.lit(".txt")))
        .otherwise(F.concat(F.lit("Makefile"), n))
    )
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"),
        path.alias("path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.col("text").cast("binary").alias("content"),
    )
    return schemas.conform(rows, schemas.FILES)


# --- Page links: host = repository, URL path = node ---------------------------------

_URL = r"^https?://([^/?#]+)(/[^?#]*)?"


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    path = F.regexp_extract(url, _URL, 2)
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract(url, _URL, 1).alias("repo_id"),
        F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
        "html",
    )


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, src, dst, n) for every link of every page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return (
        page_nodes(spark, sf_dir)
        .select("repo_id", F.col("path").alias("src"), F.explode(links).alias("dst"))
        .groupBy("repo_id", "src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )
