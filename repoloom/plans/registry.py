"""Every operator as a named query over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom import schemas
from repoloom.functions import paths
from repoloom.functions.numbers import round_exact, zero_to_null
from repoloom.operators import (
    components,
    files as file_ops,
    graph,
    imports,
    outcomes,
    repos as repo_ops,
    resolve,
    score,
    sequences,
    serving,
    totals,
)
from repoloom.plans import graph_plan, repo_run, views
from repoloom.plans.oracles import MIN_TOKENS_CODE, MIN_TOKENS_DOCUMENTS
from repoloom.settings import Settings
from repoloom.sources import corpus as corpus_io, results, tables, trees
from repoloom.sources.staging import Staging
from repoloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

DEFAULTS = Settings()
# The supplied tables give small repositories, so the token gate is scaled to them.
CODE_SETTINGS = Settings(min_tokens=MIN_TOKENS_CODE)

def packed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code files, derived from the supplied orders by every query anew."""
    return views.code_files(spark, sf_dir)


def _nine(column: str) -> Column:
    return round_exact(F.col(column), 9).alias(column)


# --- Repositories -----------------------------------------------------------------


def repo_scan(spark, sf_dir):
    return views.repos(spark, sf_dir)


def derive_full_name(spark, sf_dir):
    return repo_ops.with_names(views.repos(spark, sf_dir)).select("id", "full_name", "url")


def resume_anti(spark, sf_dir):
    done = views.stored(spark, sf_dir).select("repo_id").distinct()
    return repo_ops.unprocessed(views.repos(spark, sf_dir), done).select("id", "full_name", "url")


def resume_limit(spark, sf_dir):
    done = views.stored(spark, sf_dir).select("repo_id").distinct()
    first = repo_ops.first_repos(views.repos(spark, sf_dir), 25)
    return repo_ops.unprocessed(first, done).select("id", "full_name", "url")


def metadata_latest(spark, sf_dir):
    return repo_ops.latest_metadata(views.metadata(spark, sf_dir))


def _gated(spark, sf_dir):
    return outcomes.first_gates(
        repo_ops.with_names(views.repos(spark, sf_dir)),
        repo_ops.latest_metadata(views.metadata(spark, sf_dir)),
        views.snapshots(spark, sf_dir),
        DEFAULTS,
    )


def metadata_join(spark, sf_dir):
    named = repo_ops.with_names(views.repos(spark, sf_dir))
    found = repo_ops.latest_metadata(views.metadata(spark, sf_dir))
    return repo_ops.with_metadata(named, found).select(
        "id", "full_name", "has_metadata", "size_kb", "language", "default_branch"
    )


def size_gate(spark, sf_dir):
    gate = F.coalesce("early_status", F.lit("candidate")).alias("gate")
    return _gated(spark, sf_dir).select("id", "full_name", "size_kb", gate)


# --- Files and tokens ---------------------------------------------------------------


def file_scan(spark, sf_dir):
    """The documents as files, written as source trees (everything far below one folder) and
    as a packed table, and read back from both."""
    staging = Staging(spark)
    files = views.document_files(spark, sf_dir)
    root, packed = (staging.path(n).removeprefix("file:") for n in ("trees", "packed"))
    below = files.withColumn("path", F.concat(F.lit("src/main/x/"), F.col("path")))
    staging.save(trees.write_tree(below, root), "written")
    tables.pack_files(files, packed, 16)
    scanned = trees.with_content(trees.list_tree(spark, root, staging=staging, walked=100)).withColumn("held", F.lit("tree"))
    stored = tables.read_files(spark, packed).withColumn("held", F.lit("packed"))
    columns = ("held", "repo_id", "path", "size_bytes", F.md5("content").alias("digest"))
    return scanned.select(*columns).unionByName(stored.select(*columns))


def file_features(spark, sf_dir):
    featured = file_ops.with_path_features(views.document_files(spark, sf_dir), DEFAULTS)
    return file_ops.with_text(featured).select(
        "repo_id", "path", "extension", "directory", "language", "counted",
        F.length("text").cast("bigint").alias("characters"),
    )


def file_filter(spark, sf_dir):
    files = file_ops.unpruned(views.document_files(spark, sf_dir), DEFAULTS)
    return (
        file_ops.with_path_features(files, DEFAULTS)
        .filter("counted")
        .select("repo_id", "path", "size_bytes")
    )


def lang_route(spark, sf_dir):
    files = file_ops.unpruned(packed_code(spark, sf_dir), DEFAULTS)
    return (
        file_ops.with_path_features(files, DEFAULTS)
        .filter(F.col("language").isNotNull())
        .select("repo_id", "path", "language")
    )


def _document_tokens(spark, sf_dir):
    """Counted documents with their token counts; `readable` comes along."""
    files = file_ops.relevant(views.document_files(spark, sf_dir), DEFAULTS).filter("counted")
    return file_ops.with_tokens(file_ops.with_text(files), DEFAULTS)


def token_count(spark, sf_dir):
    return _document_tokens(spark, sf_dir).select("repo_id", "path", "extension", "tokens", "counter")


def _document_totals(spark, sf_dir):
    return totals.token_totals(_document_tokens(spark, sf_dir))


def token_totals(spark, sf_dir):
    return _document_totals(spark, sf_dir).drop("tokens_by_extension")


def tokens_by_ext(spark, sf_dir):
    return _document_totals(spark, sf_dir).select(
        "repo_id", F.explode("tokens_by_extension").alias("extension", "tokens")
    )


def token_gate(spark, sf_dir):
    few = totals.too_few_tokens(
        F.col("total_tokens"), MIN_TOKENS_DOCUMENTS, F.col("counter"), DEFAULTS.counter_name
    )
    return _document_totals(spark, sf_dir).select(
        "repo_id",
        "total_tokens",
        F.when(few, F.lit("skipped")).otherwise(F.lit("passed")).alias("gate"),
    )


# --- Import statements ----------------------------------------------------------------


def _facts(spark, sf_dir):
    return file_ops.file_facts(packed_code(spark, sf_dir), DEFAULTS)


def _staged_facts(spark, sf_dir, staging):
    return staging.save(_facts(spark, sf_dir), "facts").df


def py_imports(spark, sf_dir):
    return (
        _facts(spark, sf_dir)
        .select("repo_id", "path", F.explode("modules").alias("m"))
        .groupBy("repo_id", "path", F.col("m.module").alias("module"), F.col("m.level").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _raw_targets(language: str) -> Query:
    def query(spark, sf_dir):
        return (
            _facts(spark, sf_dir)
            .filter(F.col("language") == language)
            .select("repo_id", "path", F.explode("targets").alias("target"))
            .groupBy("repo_id", "path", "target")
            .agg(F.count(F.lit(1)).alias("n"))
        )

    return query


def module_index(spark, sf_dir):
    files = file_ops.unpruned(packed_code(spark, sf_dir), DEFAULTS)
    return resolve.module_index(files)


def _python_edges(relative: str) -> Query:
    settings = Settings(relative_imports=relative)

    def query(spark, sf_dir):
        staging = Staging(spark)
        return resolve.python_edges(_staged_facts(spark, sf_dir, staging), settings, staging)

    return query


def path_normalize(spark, sf_dir):
    target = F.col("target")
    return (
        _facts(spark, sf_dir)
        .filter(F.col("language").isin("javascript", "c"))
        .select("repo_id", F.col("path").alias("src"), "directory", F.explode("targets").alias("target"))
        .groupBy("repo_id", "src", "directory", "target")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "repo_id", "src", "target",
            paths.locate(F.col("directory"), target).alias("dst"), "n",
        )
    )


# --- Graph ------------------------------------------------------------------------------


def _code_graph(spark, sf_dir, staging):
    """(source files, edges, node table) of the code files."""
    facts = _staged_facts(spark, sf_dir, staging)
    edges = staging.save(resolve.all_edges(facts, DEFAULTS, staging), "edges").df
    sources = facts.filter(F.col("language").isNotNull()).select("repo_id", "path")
    return sources, edges, graph.node_table(sources, edges)


def import_counts(spark, sf_dir):
    _, edges, _ = _code_graph(spark, sf_dir, Staging(spark))
    return edges.groupBy("repo_id").agg(
        F.sum("n").alias("internal_import_count"),
        F.count(F.lit(1)).alias("unique_internal_imports"),
    )


def graph_nodes_edges(spark, sf_dir):
    _, edges, nodes = _code_graph(spark, sf_dir, Staging(spark))
    as_rows = nodes.select(
        "repo_id", F.lit("node").alias("kind"), F.col("node").alias("src"),
        F.lit(None).cast("string").alias("dst"), F.col("in_degree").alias("n"),
    )
    return as_rows.unionByName(edges.select("repo_id", F.lit("edge").alias("kind"), "src", "dst", "n"))


def in_degree(spark, sf_dir):
    _, _, nodes = _code_graph(spark, sf_dir, Staging(spark))
    return graph.degree_metrics(nodes).select(
        "repo_id", "nodes", _nine("avg_in_degree"), "max_in_degree"
    )


def graph_density(spark, sf_dir):
    nodes = graph.node_table(views.page_nodes(spark, sf_dir), views.page_edges(spark, sf_dir))
    return graph.degree_metrics(nodes).select(
        "repo_id", "nodes", "edges", _nine("density")
    ).withColumnRenamed("density", "graph_density")


def _component_columns(nodes, edges, staging, **choices):
    sizes = components.component_sizes(edges, staging, **choices)
    return graph.graph_metrics(nodes, sizes).select(
        "repo_id",
        F.col("components").alias("num_connected_components"),
        round_exact(F.col("largest_fraction"), 9).alias("largest_component_fraction"),
    )


def components_query(spark, sf_dir):
    staging = Staging(spark)
    _, edges, nodes = _code_graph(spark, sf_dir, staging)
    return _component_columns(nodes, edges, staging)


def components_contracted(spark, sf_dir):
    """The same with contraction down to a few thousand edges, without forests before."""
    staging = Staging(spark)
    _, edges, nodes = _code_graph(spark, sf_dir, staging)
    return _component_columns(nodes, edges, staging, batch_forests=False, final_edges=4096)


def page_components(spark, sf_dir):
    staging = Staging(spark)
    edges = staging.save(views.page_edges(spark, sf_dir), "edges").df
    return _component_columns(
        graph.node_table(views.page_nodes(spark, sf_dir), edges), edges, staging
    )


def _nine_places(metrics):
    doubles = {f.name for f in metrics.schema if f.dataType.typeName() == "double"}
    return metrics.select(*[_nine(c) if c in doubles else F.col(c) for c in metrics.columns])


def dependency_score(spark, sf_dir):
    staging = Staging(spark)
    facts = _staged_facts(spark, sf_dir, staging)
    return _nine_places(graph_plan.metrics_from_facts(facts, DEFAULTS, staging))


def _page_metrics(spark, sf_dir):
    return graph_plan.metrics_from_edges(
        views.page_nodes(spark, sf_dir), views.page_edges(spark, sf_dir), DEFAULTS, Staging(spark)
    )


def page_score(spark, sf_dir):
    return _nine_places(_page_metrics(spark, sf_dir))


def result_rounding(spark, sf_dir):
    ratio = (F.col("o_orderkey") % 401).cast("double") / (1 + F.col("o_custkey") % 400)
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        round_exact(ratio, 4).alias("four_places"),
        round_exact(zero_to_null(ratio), 6).alias("six_places"),
    )


# --- Outcomes -----------------------------------------------------------------------------


def _outcome_rows(spark, sf_dir):
    """One run over a list that names every fourth repository twice."""
    listed = views.repos(spark, sf_dir)
    again = listed.filter(F.substring("id", 2, 20).cast("bigint") % 4 == 0)
    return repo_run.run(
        listed.unionByName(again),
        views.metadata(spark, sf_dir),
        views.snapshots(spark, sf_dir),
        packed_code(spark, sf_dir),
        views.stored(spark, sf_dir),
        Staging(spark),
        CODE_SETTINGS,
    )


def _comparable(rows):
    """Without the clock, and with the map as ordered text."""
    entries = F.array_sort(F.map_entries("tokens_by_extension"))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return rows.withColumn("tokens_by_extension", text).drop("processed_at")


def repo_outcomes(spark, sf_dir):
    return _comparable(_outcome_rows(spark, sf_dir))


def run_summary(spark, sf_dir):
    return outcomes.status_counts(_outcome_rows(spark, sf_dir))


def run_progress(spark, sf_dir):
    return outcomes.progress_counts(
        views.repos(spark, sf_dir), views.stored(spark, sf_dir), _outcome_rows(spark, sf_dir)
    )


def _stored_in_runs(spark, sf_dir):
    """The outcome rows in a stored table, as days leave it: a named run of every second
    repository, the same run again after it was refused for repeated rows, a compaction, and
    a run without a name for the others."""
    staging = Staging(spark)
    rows = staging.save(_outcome_rows(spark, sf_dir), "outcomes").df
    path = staging.path("results")
    early = F.substring("repo_id", 2, 20).cast("bigint") % 2 == 0
    results.store(rows.filter(early & (F.col("processing_status") != "skipped")), path, "day 1")
    if not rows.filter(early).isEmpty():
        try:
            results.store(rows.filter(early).unionByName(rows.filter(early)), path, "day 1")
            raise AssertionError("repeated repositories were stored")
        except results.ConstraintError:
            pass
    results.store(rows.filter(early), path, "day 1")
    results.compact(spark, path)
    results.store(rows.filter(~early), path)
    return path


def stored_results(spark, sf_dir):
    return _comparable(results.read_results(spark, _stored_in_runs(spark, sf_dir)))


def stored_constraints(spark, sf_dir):
    return results.constraint_violations(results.read_results(spark, _stored_in_runs(spark, sf_dir)))


def status_lookup(spark, sf_dir):
    found = results.lookup(spark, _stored_in_runs(spark, sf_dir), "skipped", "error")
    return found.select("repo_id", "full_name", "error_message")


def incremental_run(spark, sf_dir):
    """A delivery of the repository list and a second one, overlapping by a third, each
    taken up by the resumed stream; a third one by a second stream with a checkpoint of
    its own, into the same results; then the whole list once more as a batch, which
    must not add anything."""
    staging = Staging(spark)
    arrivals, stored, progress = (staging.path(n) for n in ("arrivals", "results", "progress"))
    more, other_progress = staging.path("more-arrivals"), staging.path("other-progress")
    listed = views.repos(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("bigint")
    inputs = incremental.Inputs(
        views.metadata(spark, sf_dir), views.snapshots(spark, sf_dir), packed_code(spark, sf_dir)
    )
    for delivery in (number % 3 == 0, number % 3 < 2):
        listed.filter(delivery).write.mode("append").parquet(arrivals)
        incremental.run_stream(spark, arrivals, inputs, stored, progress, CODE_SETTINGS)
    listed.filter(number % 3 > 0).write.parquet(more)
    incremental.run_stream(spark, more, inputs, stored, other_progress, CODE_SETTINGS)
    incremental.run_and_store(spark, listed, inputs, stored, CODE_SETTINGS)
    return _comparable(results.read_results(spark, stored))


def _result_like(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the result layout; columns not given get 0, "" or NULL."""
    filled = {}
    for field in schemas.RESULT:
        if field.name in columns:
            value = columns[field.name]
        elif field.nullable:
            value = F.lit(None)
        elif field.dataType.typeName() == "string":
            value = F.lit("")
        else:
            value = F.lit(0)
        filled[field.name] = value.cast(field.dataType).alias(field.name)
    return df.select(*filled.values())


def result_constraints(spark, sf_dir):
    listed = views.repos(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("bigint")
    dirty = listed.unionByName(listed.filter(number % 4 == 0))
    rows = _result_like(
        dirty, id=F.col("id"), repo_id=F.col("id"), full_name=F.col("full_name"), url=F.col("url")
    )
    return results.constraint_violations(rows)


def upsert_latest(spark, sf_dir):
    """A table that holds two thirds of the repositories takes updates for three
    quarters, each delivered twice; only the later delivery counts."""
    k = F.substring("id", 2, 20).cast("bigint")
    listed = views.repos(spark, sf_dir)

    def rows(df, done, status, density, tokens, message, second):
        return _result_like(
            df,
            id=F.col("id"),
            repo_id=F.col("id"),
            processing_status=F.when(done, F.lit("completed")).otherwise(F.lit(status)),
            graph_density=F.when(done, density),
            total_code_tokens=tokens,
            error_message=F.when(~done, F.concat(F.lit(message), k.cast("string"))),
            processed_at=F.timestamp_seconds(F.lit(second)),
        )

    existing = rows(listed.filter(k % 3 != 0), k % 2 == 0, "error", k / 1000.0, k * 10, "first ", 1)
    fresh = listed.filter(k % 4 != 0)
    early = rows(fresh, k % 5 < 4, "skipped", k / 10.0, k, "never ", 2)
    late = rows(fresh, k % 5 < 3, "skipped", (k + 1) / 1000.0, k * 20 + 1, "second ", 3)
    merged = results.upsert(existing, early.unionByName(late))
    return merged.select(
        "repo_id", "processing_status", "graph_density", "total_code_tokens", "error_message",
        F.unix_seconds("processed_at").cast("int").alias("first_seen"),
    )


# --- Serving -------------------------------------------------------------------------------


def topk_score(spark, sf_dir):
    scored = score.rounded(_page_metrics(spark, sf_dir))
    path = Staging(spark).path("results")
    rows = _result_like(
        scored, id=F.col("repo_id"), repo_id=F.col("repo_id"), dependency_score=F.col("dependency_score"),
        processing_status=F.lit("completed"), processed_at=F.current_timestamp(),
    )
    results.store(rows, path)
    results.compact(spark, path)
    return results.top_scores(spark, path, 20).select("repo_id", "dependency_score")


def topk_tokens(spark, sf_dir):
    return serving.top_by(_document_totals(spark, sf_dir), "total_tokens", 10).select(
        "repo_id", "total_tokens"
    )


def score_buckets(spark, sf_dir):
    scored = score.rounded(_page_metrics(spark, sf_dir))
    number = serving.bucket(F.col("dependency_score"), (0.25, 0.5, 0.75))
    return scored.groupBy(number.alias("bucket")).agg(
        F.count(F.lit(1)).alias("repos"),
        F.min("dependency_score").alias("lowest"),
        F.max("dependency_score").alias("highest"),
    )


def score_buckets_quantile(spark, sf_dir):
    """Documents by quarters of their token counts, a hot value included."""
    counted = _document_tokens(spark, sf_dir).select(F.col("tokens").cast("double").alias("tokens"))
    return serving.quantile_buckets(counted, "tokens", 4).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("files"), F.min("tokens").alias("lowest"), F.max("tokens").alias("highest")
    )


MIXTURE_EDGES = (60, 120)
MIXTURE_WEIGHTS = {0: 1, 1: 3, 2: 2}


def mixture_sample(spark, sf_dir):
    # Counts are written down first: the draw looks at them several times.
    measured = _document_tokens(spark, sf_dir).select("repo_id", "path", "tokens")
    lengths = Staging(spark).save(measured, "lengths").df.select(
        "repo_id", "path", F.concat_ws("/", "repo_id", "path").alias("key"),
        serving.bucket(F.col("tokens"), (100, 1000)).alias("length_bucket"),
    )
    drawn = serving.mixture(lengths, "key", "length_bucket", {0: 0.1, 1: 0.5, 2: 0.9}, seed=7)
    return drawn.select("repo_id", "path", "length_bucket")


def mixture_tokens(spark, sf_dir):
    """Documents drawn so that short, middle and long ones give 1, 3 and 2 parts of the tokens."""
    measured = _document_tokens(spark, sf_dir).select(
        "repo_id", "path", "tokens", F.concat_ws("/", "repo_id", "path").alias("key"),
        serving.bucket(F.col("tokens"), MIXTURE_EDGES).alias("length_bucket"),
    )
    lengths = Staging(spark).save(measured, "lengths").df
    drawn = serving.mixture_by_tokens(lengths, "key", "length_bucket", "tokens", MIXTURE_WEIGHTS, seed=7)
    return drawn.select("repo_id", "path", "length_bucket")


# --- Corpus ----------------------------------------------------------------------------------


def _conversation_text(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select("text")


def corpus_json(spark, sf_dir):
    path = Staging(spark).path("corpus.jsonl")
    corpus_io.export_corpus(_conversation_text(spark, sf_dir), path)
    return corpus_io.read_corpus(spark, path)


def corpus_text(spark, sf_dir):
    path = Staging(spark).path("corpus.txt")
    _conversation_text(spark, sf_dir).select(F.regexp_replace("text", r"[\r\n]+", " ")).write.text(path)
    return corpus_io.read_corpus(spark, path)


def corpus_tokenize(spark, sf_dir):
    return sequences.tokenize(_conversation_text(spark, sf_dir), 64).select(
        F.array_join("input_ids", " ").alias("input_ids"),
        F.size("attention_mask").alias("n_tokens"),
    )


def corpus_stats(spark, sf_dir):
    return sequences.corpus_size(corpus_json(spark, sf_dir))


def corpus_export(spark, sf_dir):
    """Texts of the counted files of repositories with enough tokens, written as
    training records and read back."""
    files = _document_tokens(spark, sf_dir)
    enough = _document_totals(spark, sf_dir).filter(
        F.col("total_tokens") >= MIN_TOKENS_DOCUMENTS
    )
    chosen = Staging(spark).save(enough.select("repo_id"), "chosen").df
    kept = tables.files_of(files, chosen).join(chosen, "repo_id", "left_semi")
    path = Staging(spark).path("corpus.jsonl")
    corpus_io.export_corpus(kept, path)
    return corpus_io.read_corpus(spark, path)


def queries() -> dict[str, Query]:
    return {
        "repo_scan": repo_scan,
        "derive_full_name": derive_full_name,
        "resume_anti": resume_anti,
        "resume_limit": resume_limit,
        "metadata_latest": metadata_latest,
        "metadata_join": metadata_join,
        "size_gate": size_gate,
        "file_scan": file_scan,
        "file_features": file_features,
        "file_filter": file_filter,
        "lang_route": lang_route,
        "token_count": token_count,
        "token_totals": token_totals,
        "tokens_by_ext": tokens_by_ext,
        "token_gate": token_gate,
        "py_imports": py_imports,
        "js_imports": _raw_targets("javascript"),
        "c_includes": _raw_targets("c"),
        "rust_uses": _raw_targets("rust"),
        "module_index": module_index,
        "py_resolve": _python_edges("drop"),
        "py_relative": _python_edges("resolve"),
        "path_normalize": path_normalize,
        "import_counts": import_counts,
        "graph_nodes_edges": graph_nodes_edges,
        "in_degree": in_degree,
        "graph_density": graph_density,
        "components": components_query,
        "components_contracted": components_contracted,
        "page_components": page_components,
        "dependency_score": dependency_score,
        "page_score": page_score,
        "result_rounding": result_rounding,
        "repo_outcomes": repo_outcomes,
        "run_summary": run_summary,
        "run_progress": run_progress,
        "status_lookup": status_lookup,
        "stored_results": stored_results,
        "stored_constraints": stored_constraints,
        "incremental_run": incremental_run,
        "result_constraints": result_constraints,
        "upsert_latest": upsert_latest,
        "topk_score": topk_score,
        "topk_tokens": topk_tokens,
        "score_buckets": score_buckets,
        "score_buckets_quantile": score_buckets_quantile,
        "mixture_sample": mixture_sample,
        "mixture_tokens": mixture_tokens,
        "corpus_json": corpus_json,
        "corpus_text": corpus_text,
        "corpus_tokenize": corpus_tokenize,
        "corpus_stats": corpus_stats,
        "corpus_export": corpus_export,
    }
