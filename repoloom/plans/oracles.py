"""The registered queries in plain SQL over the supplied tables.

The code-file answers come from the numbers the statements were generated from,
not from parsing text, wherever that is possible.
"""

from __future__ import annotations

MIN_TOKENS_CODE = 1_800
MIN_TOKENS_DOCUMENTS = 9_000
TOKENS = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"

_SLUG = "'org' || s_nationkey || '/p' || s_suppkey"

_VIEWS = {
    # --- one row per supplier
    "repos": f"""
        SELECT s_suppkey AS k, 'r' || s_suppkey AS id,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN ''
                    ELSE {_SLUG} END AS full_name,
               CASE WHEN s_suppkey % 10 <> 0 THEN 'https://github.com/' || {_SLUG} END AS url,
               n_name AS conference, CAST(2018 + s_suppkey % 8 AS INTEGER) AS year,
               s_name AS paper_title
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "named": """
        SELECT * FROM (
            SELECT k, id,
                   COALESCE(NULLIF(full_name, ''),
                            NULLIF(REPLACE(url, 'https://github.com/', ''), '')) AS full_name,
                   url, conference, year, paper_title
            FROM repos)
        WHERE full_name IS NOT NULL""",
    "harvest": f"""
        SELECT {_SLUG} AS full_name,
               CAST(FLOOR(ABS(s_acctbal) / 20) AS BIGINT) * age AS size_kb,
               CASE s_suppkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript'
                    WHEN 2 THEN 'C' END AS language,
               CASE WHEN s_suppkey % 6 <> 0 THEN 'trunk' END AS default_branch,
               CASE WHEN s_suppkey % 17 = 5 THEN 404 ELSE 200 END AS http_status,
               age AS fetched_at
        FROM supplier, (VALUES (0), (1)) ages(age)
        WHERE s_suppkey % 11 <> 0 AND (age = 1 OR s_suppkey % 3 = 0)""",
    "metadata": """
        SELECT full_name, COALESCE(size_kb, 0) AS size_kb, language,
               COALESCE(default_branch, 'main') AS default_branch
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY full_name ORDER BY fetched_at DESC) AS n
              FROM harvest WHERE http_status BETWEEN 200 AND 299)
        WHERE n = 1""",
    "gated": """
        SELECT d.*, m.full_name IS NOT NULL AS has_metadata, m.size_kb, m.language,
               m.default_branch,
               CASE WHEN m.full_name IS NULL THEN 'github_api_failed'
                    WHEN m.size_kb < 200 THEN 'skipped'
                    WHEN d.k % 13 = 0 THEN 'clone_failed' END AS early_status
        FROM named d LEFT JOIN metadata m ON d.full_name = m.full_name""",
    # --- one row per order
    "numbered": """
        SELECT o_orderkey AS x, o_orderkey % 3 = 0 OR o_orderkey // 150 = 2 AS hot,
               CASE WHEN o_orderkey % 3 = 0 OR o_orderkey // 150 = 2 THEN 2
                    ELSE o_orderkey // 150 END AS repo
        FROM orders""",
    "code": """
        SELECT *, 'r' || repo AS repo_id,
               CASE x % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/core/' WHEN 2 THEN 'lib/'
                    WHEN 3 THEN 'data/' ELSE '' END
               || 'm' || x
               || CASE x % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.h' ELSE '.rs' END
                   AS path,
               NOT hot AND x % 150 = 16 AND repo % 7 = 4 AS unreadable
        FROM numbered""",
    "statements": """
        SELECT c.*, j,
               CASE WHEN hot THEN (x // 6 + (j * j + j // 7) % 11) * 3
                    ELSE repo * 150 + (x - repo * 150) // 2 + 2 * ((j * j + j // 7) % 11) END AS t
        FROM code c, range(1, 8) steps(j)
        WHERE j <= x % 7 + 1""",
    "dotted": """
        SELECT *, CASE WHEN j = 7 THEN ''
                       ELSE CASE t % 5 WHEN 0 THEN 'src.' WHEN 1 THEN 'src.core.'
                            WHEN 2 THEN 'lib.' WHEN 3 THEN 'data.' ELSE '' END END
                  || 'm' || t || CASE WHEN j = 2 THEN '.attr' ELSE '' END AS module
        FROM statements WHERE x % 4 = 0""",
    "written": """
        SELECT s.x, s.j, s.repo_id, s.path, s.unreadable,
               CASE s.x % 4
                    WHEN 0 THEN CASE WHEN s.j = 7 THEN 'from .' || module || ' import x'
                                     ELSE 'import ' || module END
                    WHEN 1 THEN CASE WHEN s.j = 7 THEN 'const y = require(''../m' || s.t || ''')'
                                     ELSE 'import x from ''./m' || s.t || '''' END
                    WHEN 2 THEN '#include "../lib/m' || s.t || '.h"'
                    ELSE 'use crate::m' || s.t || '::f;' END AS line
        FROM statements s LEFT JOIN dotted d ON s.x = d.x AND s.j = d.j""",
    "texts": """
        SELECT x, repo_id, path, unreadable, STRING_AGG(line, CHR(10) ORDER BY j) AS text
        FROM written GROUP BY x, repo_id, path, unreadable""",
    "usable": "SELECT * FROM statements WHERE x % 5 <> 3 AND NOT unreadable",
    "python_hits": """
        SELECT u.repo_id, u.path AS src, c.path AS dst, u.j = 7 AS relative, COUNT(*) AS n
        FROM usable u JOIN code c ON u.t = c.x AND u.repo = c.repo
        WHERE u.x % 4 = 0 AND u.t % 4 = 0 AND u.t % 5 <> 3 AND u.t <> u.x
              AND (u.j <> 7 OR u.t % 5 = u.x % 5)
        GROUP BY ALL""",
    "located": """
        SELECT repo_id, path AS src,
               CASE WHEN x % 4 = 1 AND j < 7 THEN './m' || t WHEN x % 4 = 1 THEN '../m' || t
                    ELSE '../lib/m' || t || '.h' END AS target,
               CASE WHEN x % 4 = 1 AND j < 7
                    THEN CASE x % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/core/'
                              WHEN 2 THEN 'lib/' ELSE '' END || 'm' || t
                    WHEN x % 4 = 1
                    THEN CASE x % 5 WHEN 1 THEN 'src/' WHEN 4 THEN '../' ELSE '' END || 'm' || t
                    ELSE CASE x % 5 WHEN 1 THEN 'src/' WHEN 4 THEN '../' ELSE '' END
                         || 'lib/m' || t || '.h' END AS dst
        FROM usable WHERE x % 4 IN (1, 2)""",
    "edges": """
        SELECT repo_id, src, dst, SUM(n) AS n FROM python_hits WHERE NOT relative
        GROUP BY repo_id, src, dst
        UNION ALL
        SELECT repo_id, src, dst, COUNT(*) FROM located GROUP BY repo_id, src, dst
        UNION ALL
        SELECT repo_id, path, 'm' || t, COUNT(*) FROM usable WHERE x % 4 = 3
        GROUP BY repo_id, path, t""",
    "sources": "SELECT repo_id, path FROM code WHERE x % 5 <> 3",
    # --- pages
    "page_paths": r"""
        SELECT page_id, html, REGEXP_EXTRACT(url, '^https?://([^/?#]+)', 1) AS repo_id,
               COALESCE(NULLIF(REGEXP_EXTRACT(url, '^https?://[^/?#]+(/[^?#]*)?', 1), ''), '/')
                   AS path
        FROM pages""",
    "page_sources": "SELECT DISTINCT repo_id, path FROM page_paths",
    "page_edges": """
        SELECT repo_id, path AS src, dst, COUNT(*) AS n
        FROM (SELECT repo_id, path,
                     UNNEST(REGEXP_EXTRACT_ALL(html, 'href="([^"]+)"', 1)) AS dst
              FROM page_paths)
        GROUP BY ALL""",
    # --- documents as files
    "document_files": """
        SELECT doc_id, source AS repo_id, text, STRLEN(text) AS size_bytes,
               CASE doc_id % 7 WHEN 0 THEN 'src/' || doc_id || '.py'
                    WHEN 1 THEN 'docs/' || doc_id || '.md' WHEN 2 THEN 'tab/' || doc_id || '.csv'
                    WHEN 3 THEN 'R/' || doc_id || '.R'
                    WHEN 4 THEN 'node_modules/' || doc_id || '.js'
                    WHEN 5 THEN 'x.egg-info/' || doc_id || '.txt'
                    ELSE 'Makefile' || doc_id END AS path,
               CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.csv'
                    WHEN 3 THEN '.r' WHEN 4 THEN '.js' WHEN 5 THEN '.txt' ELSE '' END
                   AS extension
        FROM documents""",
    "document_tokens": f"""
        SELECT repo_id, path, extension, size_bytes,
               LEN(REGEXP_EXTRACT_ALL(text, '{TOKENS}')) AS tokens
        FROM document_files
        WHERE doc_id % 7 IN (0, 1, 3) AND size_bytes BETWEEN 1 AND 1000000""",
    "document_totals": """
        SELECT repo_id, CAST(SUM(tokens) AS BIGINT) AS total_tokens, COUNT(*) AS total_files,
               CAST(SUM(size_bytes) AS BIGINT) AS total_bytes
        FROM document_tokens GROUP BY repo_id""",
}

_NEEDS = {
    "named": ["repos"],
    "metadata": ["harvest"],
    "gated": ["named", "metadata"],
    "code": ["numbered"],
    "statements": ["code"],
    "dotted": ["statements"],
    "written": ["dotted"],
    "texts": ["written"],
    "usable": ["statements"],
    "python_hits": ["usable"],
    "located": ["usable"],
    "edges": ["python_hits", "located"],
    "sources": ["code"],
    "page_sources": ["page_paths"],
    "page_edges": ["page_paths"],
    "document_tokens": ["document_files"],
    "document_totals": ["document_tokens"],
}


def _graph(sources: str, edges: str) -> dict[str, str]:
    """Node, component and score views over a source list and an edge list."""
    return {
        "nodes": f"""
        SELECT repo_id, node, CAST(SUM(d) AS BIGINT) AS in_degree
        FROM (SELECT repo_id, path AS node, 0 AS d FROM {sources}
              UNION ALL SELECT repo_id, dst, 1 FROM {edges})
        GROUP BY repo_id, node""",
        "degrees": """
        SELECT repo_id, COUNT(*) AS nodes, CAST(SUM(in_degree) AS BIGINT) AS edges,
               MAX(in_degree) AS max_in_degree
        FROM nodes GROUP BY repo_id""",
        "occurrences": f"""
        SELECT repo_id, CAST(SUM(n) AS BIGINT) AS occurrences, COUNT(*) AS distinct_edges
        FROM {edges} GROUP BY repo_id""",
        "both_ways": f"""
        SELECT DISTINCT repo_id, a, b
        FROM (SELECT repo_id, src AS a, dst AS b FROM {edges}
              UNION ALL SELECT repo_id, dst, src FROM {edges})
        WHERE a <> b""",
        "numbers": """
        SELECT repo_id, node, ROW_NUMBER() OVER () AS v FROM nodes""",
        "links": """
        SELECT x.v AS a, y.v AS b
        FROM both_ways w JOIN numbers x ON w.repo_id = x.repo_id AND w.a = x.node
             JOIN numbers y ON w.repo_id = y.repo_id AND w.b = y.node""",
        "labels_found(v, label) USING KEY (v)": """
        SELECT v, v FROM numbers
        UNION
        SELECT l.b, MIN(u.label)
        FROM labels_found u JOIN links l ON u.v = l.a
             JOIN recurring.labels_found known ON known.v = l.b
        WHERE u.label < known.label GROUP BY l.b""",
        "component_sizes": """
        SELECT repo_id, label, COUNT(*) AS size
        FROM numbers JOIN labels_found USING (v) GROUP BY repo_id, label""",
        "component_counts": """
        SELECT repo_id, COUNT(*) AS components, MAX(size) AS largest
        FROM component_sizes GROUP BY repo_id""",
        "metrics": """
        SELECT repo_id, nodes, edges, occurrences,
               CASE WHEN nodes < 2 THEN 0 ELSE
                   GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE,
                       0.25::DOUBLE * LEAST(density * 10, 1.0::DOUBLE)
                       + 0.25::DOUBLE * LEAST(avg_in / LN(GREATEST(nodes, 2)), 1.0::DOUBLE)
                       + 0.30::DOUBLE * fraction
                       + 0.20::DOUBLE * LEAST(avg_in, 1.0::DOUBLE))) END AS score,
               CASE WHEN nodes < 2 THEN 0 ELSE density END AS density,
               CASE WHEN nodes < 2 THEN 0 ELSE avg_in END AS avg_in,
               CASE WHEN nodes < 2 THEN 0 ELSE max_in_degree END AS max_in_degree,
               CASE WHEN nodes < 2 THEN 0 ELSE components END AS components,
               CASE WHEN nodes < 2 THEN 0 ELSE fraction END AS fraction
        FROM (SELECT repo_id, nodes, d.edges AS edges, COALESCE(occurrences, 0) AS occurrences,
                     max_in_degree, components,
                     d.edges::DOUBLE / NULLIF(nodes * (nodes - 1), 0)::DOUBLE AS density,
                     d.edges::DOUBLE / nodes::DOUBLE AS avg_in,
                     largest::DOUBLE / nodes::DOUBLE AS fraction
              FROM degrees d JOIN component_counts USING (repo_id)
                   LEFT JOIN occurrences USING (repo_id))""",
    }


_GRAPH_NEEDS = {
    "degrees": ["nodes"],
    "numbers": ["nodes"],
    "links": ["both_ways", "numbers"],
    "labels_found(v, label) USING KEY (v)": ["links"],
    "component_sizes": ["labels_found(v, label) USING KEY (v)"],
    "component_counts": ["component_sizes"],
    "metrics": ["degrees", "component_counts", "occurrences"],
}


def _query(body: str, *views: str, graph: tuple[str, str] | None = None) -> str:
    """`body` with the views it names, and theirs, as common table expressions."""
    texts, needs = dict(_VIEWS), dict(_NEEDS)
    if graph:
        texts.update(_graph(*graph))
        needs.update(_GRAPH_NEEDS)
        for name in ("nodes", "both_ways", "occurrences"):
            needs[name] = list(graph)
    order: list[str] = []

    def add(name: str) -> None:
        for need in needs.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    parts = []
    for name in order:
        # Views read several times, and row numbers, must be computed just once.
        parts.append(f"{name} AS {'' if 'USING KEY' in name else 'MATERIALIZED '}({texts[name]})")
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def _exact(value: str, places: int) -> str:
    return f"CAST(FORMAT('{{:.{places}f}}', {value}) AS DOUBLE)"


CODE = ("sources", "edges")
PAGES = ("page_sources", "page_edges")

_METRIC_COLUMNS = f"""
    repo_id, {_exact("score", 9)} AS dependency_score, occurrences AS internal_import_count,
    edges AS unique_internal_imports, {_exact("density", 9)} AS graph_density,
    {_exact("avg_in", 9)} AS avg_in_degree, CAST(max_in_degree AS BIGINT) AS max_in_degree,
    CAST(components AS BIGINT) AS num_connected_components,
    {_exact("fraction", 9)} AS largest_component_fraction"""

_CODE_TOTALS = f"""
    SELECT repo_id, SUM(tokens) AS total_tokens, COUNT(*) AS total_files,
           SUM(size_bytes) AS total_bytes,
           MIN(path) AS any_path
    FROM (SELECT repo_id, path, LEN(REGEXP_EXTRACT_ALL(text, '{TOKENS}')) AS tokens,
                 STRLEN(text) AS size_bytes
          FROM texts WHERE x % 5 <> 3 AND NOT unreadable)
    GROUP BY repo_id"""

_CODE_MAPS = f"""
    SELECT repo_id, STRING_AGG(ext || '=' || tokens, ',' ORDER BY ext) AS tokens_by_extension
    FROM (SELECT repo_id, REGEXP_EXTRACT(path, '\\.[a-z]+$') AS ext,
                 SUM(LEN(REGEXP_EXTRACT_ALL(text, '{TOKENS}'))) AS tokens
          FROM texts WHERE x % 5 <> 3 AND NOT unreadable GROUP BY ALL)
    GROUP BY repo_id"""


def _outcomes(condition: str, order_by: str = "") -> str:
    """Outcome rows over repositories that meet a condition on `k`."""
    done = "status = 'completed'"
    return _query(
        f"""
    SELECT SUBSTR(SHA256(repo_id), 1, 32) AS id, repo_id, full_name, url, github_size_kb,
           primary_language, default_branch,
           CASE WHEN {done} THEN total_tokens ELSE 0 END AS total_code_tokens,
           CASE WHEN {done} THEN total_files ELSE 0 END AS total_code_files,
           CASE WHEN {done} THEN total_bytes ELSE 0 END AS total_code_bytes,
           CASE WHEN {done} THEN tokens_by_extension END AS tokens_by_extension,
           CASE WHEN {done} AND total_tokens IS NOT NULL THEN 'pattern' END AS token_counter,
           CASE WHEN {done} THEN {_exact("score", 4)} ELSE 0.0 END AS dependency_score,
           CASE WHEN {done} THEN occurrences ELSE 0 END AS internal_import_count,
           CASE WHEN {done} THEN edges ELSE 0 END AS unique_internal_imports,
           CASE WHEN {done} THEN {_exact("NULLIF(density, 0)", 6)} END AS graph_density,
           CASE WHEN {done} THEN {_exact("NULLIF(avg_in, 0)", 4)} END AS avg_in_degree,
           CASE WHEN {done} THEN CAST(max_in_degree AS BIGINT) END AS max_in_degree,
           CASE WHEN {done} THEN CAST(components AS BIGINT) END AS num_connected_components,
           CASE WHEN {done} THEN {_exact("NULLIF(fraction, 0)", 4)} END
               AS largest_component_fraction,
           conference, year, paper_title, status AS processing_status,
           CASE WHEN early_status = 'skipped' THEN 'size_kb=' || github_size_kb || ' < 200'
                WHEN early_status = 'clone_failed' THEN 'shallow clone failed'
                WHEN status = 'skipped'
                    THEN 'tokens=' || total_tokens || ' < {MIN_TOKENS_CODE}'
                WHEN status = 'error' THEN 'unreadable file: ' || bad_path END AS error_message
    FROM (
        SELECT g.id AS repo_id, g.full_name, COALESCE(g.url, 'https://github.com/' || g.full_name)
                   AS url,
               COALESCE(g.size_kb, 0) AS github_size_kb, g.language AS primary_language,
               g.default_branch, g.conference, g.year, g.paper_title, g.early_status,
               CAST(COALESCE(c.total_tokens, 0) AS BIGINT) AS total_tokens,
               COALESCE(c.total_files, 0) AS total_files,
               CAST(COALESCE(c.total_bytes, 0) AS BIGINT) AS total_bytes,
               maps.tokens_by_extension, m.* EXCLUDE (repo_id), bad.bad_path,
               CASE WHEN g.early_status IS NOT NULL THEN g.early_status
                    WHEN COALESCE(c.total_tokens, 0) < {MIN_TOKENS_CODE} THEN 'skipped'
                    WHEN bad.bad_path IS NOT NULL THEN 'error'
                    ELSE 'completed' END AS status
        FROM gated g
             LEFT JOIN ({_CODE_TOTALS}) c ON g.id = c.repo_id
             LEFT JOIN ({_CODE_MAPS}) maps ON g.id = maps.repo_id
             LEFT JOIN metrics m ON g.id = m.repo_id
             LEFT JOIN (SELECT repo_id, MIN(path) AS bad_path FROM code
                        WHERE unreadable AND x % 4 = 0 AND x % 5 <> 3
                        GROUP BY repo_id) bad ON g.id = bad.repo_id
        WHERE {condition}) {order_by}""",
        "gated", "texts", "metrics", graph=CODE,
    )


def oracle_sql() -> dict[str, str]:
    unseen = "g.k % 3 <> 0"
    outcomes = _outcomes(unseen)
    return {
        # repositories
        "repo_scan": _query(
            "SELECT id, full_name, url, conference, year, paper_title FROM repos", "repos"
        ),
        "derive_full_name": _query(
            """SELECT id, full_name, COALESCE(url, 'https://github.com/' || full_name) AS url
               FROM named""",
            "named",
        ),
        "resume_anti": _query(
            """SELECT id, full_name, url FROM repos r
               WHERE NOT EXISTS (SELECT 1 FROM supplier
                                 WHERE s_suppkey % 3 = 0 AND 'r' || s_suppkey = r.id)""",
            "repos",
        ),
        "resume_limit": _query(
            """SELECT id, full_name, url FROM (SELECT * FROM repos ORDER BY id LIMIT 25) r
               WHERE NOT EXISTS (SELECT 1 FROM supplier
                                 WHERE s_suppkey % 3 = 0 AND 'r' || s_suppkey = r.id)""",
            "repos",
        ),
        "metadata_latest": _query(
            "SELECT full_name, size_kb, language, default_branch FROM metadata", "metadata"
        ),
        "metadata_join": _query(
            """SELECT id, full_name, has_metadata, size_kb, language, default_branch
               FROM gated""",
            "gated",
        ),
        "size_gate": _query(
            """SELECT id, full_name, size_kb, COALESCE(early_status, 'candidate') AS gate
               FROM gated""",
            "gated",
        ),
        # files
        "file_scan": _query(
            """SELECT 'packed' AS held, repo_id, path, size_bytes, MD5(text) AS digest FROM document_files
               UNION ALL
               SELECT 'tree', repo_id, 'src/main/x/' || path, size_bytes, MD5(text) FROM document_files""",
            "document_files",
        ),
        "file_features": _query(
            r"""SELECT repo_id, path, extension,
                       CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'docs' WHEN 2 THEN 'tab'
                            WHEN 3 THEN 'R' WHEN 4 THEN 'node_modules' WHEN 5 THEN 'x.egg-info'
                            ELSE '' END AS directory,
                       CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 4 THEN 'javascript' END
                           AS language,
                       doc_id % 7 IN (0, 1, 3, 4, 5) AND size_bytes BETWEEN 1 AND 1000000
                           AS counted,
                       LENGTH(REGEXP_REPLACE(text, '\r\n?', CHR(10), 'g')) AS characters
                FROM document_files""",
            "document_files",
        ),
        "file_filter": _query(
            """SELECT repo_id, path, size_bytes FROM document_files
               WHERE doc_id % 7 IN (0, 1, 3) AND size_bytes BETWEEN 1 AND 1000000""",
            "document_files",
        ),
        "lang_route": _query(
            """SELECT repo_id, path,
                      CASE x % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'c'
                           ELSE 'rust' END AS language
               FROM code WHERE x % 5 <> 3""",
            "code",
        ),
        # tokens
        "token_count": _query(
            "SELECT repo_id, path, extension, tokens, 'pattern' AS counter FROM document_tokens",
            "document_tokens",
        ),
        "token_totals": _query("SELECT *, 'pattern' AS counter FROM document_totals", "document_totals"),
        "tokens_by_ext": _query(
            """SELECT repo_id, extension, CAST(SUM(tokens) AS BIGINT) AS tokens
               FROM document_tokens GROUP BY ALL""",
            "document_tokens",
        ),
        "token_gate": _query(
            f"""SELECT repo_id, total_tokens,
                       CASE WHEN total_tokens < {MIN_TOKENS_DOCUMENTS} THEN 'skipped'
                            ELSE 'passed' END AS gate
                FROM document_totals""",
            "document_totals",
        ),
        # statements
        "py_imports": _query(
            """SELECT repo_id, path, module, CASE WHEN j = 7 THEN 1 ELSE 0 END AS level,
                      COUNT(*) AS n
               FROM dotted WHERE x % 5 <> 3 AND NOT unreadable GROUP BY ALL""",
            "dotted",
        ),
        "js_imports": _query(
            """SELECT repo_id, path, CASE WHEN j = 7 THEN '../m' ELSE './m' END || t AS target,
                      COUNT(*) AS n
               FROM usable WHERE x % 4 = 1 GROUP BY ALL""",
            "usable",
        ),
        "c_includes": _query(
            """SELECT repo_id, path, '../lib/m' || t || '.h' AS target, COUNT(*) AS n
               FROM usable WHERE x % 4 = 2 GROUP BY ALL""",
            "usable",
        ),
        "rust_uses": _query(
            """SELECT repo_id, path, 'm' || t AS target, COUNT(*) AS n
               FROM usable WHERE x % 4 = 3 GROUP BY ALL""",
            "usable",
        ),
        "module_index": _query(
            """SELECT repo_id, path, REPLACE(LEFT(path, LENGTH(path) - 3), '/', '.') AS module
               FROM code WHERE x % 5 <> 3 AND x % 4 = 0""",
            "code",
        ),
        "py_resolve": _query(
            """SELECT repo_id, src, dst, CAST(SUM(n) AS BIGINT) AS n
               FROM python_hits WHERE NOT relative GROUP BY repo_id, src, dst""",
            "python_hits",
        ),
        "py_relative": _query(
            """SELECT repo_id, src, dst, CAST(SUM(n) AS BIGINT) AS n
               FROM python_hits GROUP BY repo_id, src, dst""",
            "python_hits",
        ),
        "path_normalize": _query(
            "SELECT repo_id, src, target, dst, COUNT(*) AS n FROM located GROUP BY ALL", "located"
        ),
        # graph
        "import_counts": _query(
            """SELECT repo_id, occurrences AS internal_import_count,
                      distinct_edges AS unique_internal_imports FROM occurrences""",
            "occurrences", graph=CODE,
        ),
        "graph_nodes_edges": _query(
            """SELECT repo_id, 'node' AS kind, node AS src, NULL AS dst, in_degree AS n FROM nodes
               UNION ALL
               SELECT repo_id, 'edge', src, dst, CAST(n AS BIGINT) FROM edges""",
            "nodes", "edges", graph=CODE,
        ),
        "in_degree": _query(
            f"""SELECT repo_id, nodes, {_exact("edges::DOUBLE / nodes", 9)} AS avg_in_degree,
                      max_in_degree
               FROM degrees""",
            "degrees", graph=CODE,
        ),
        "graph_density": _query(
            f"""SELECT repo_id, nodes, edges,
                      {_exact("edges::DOUBLE / NULLIF(nodes * (nodes - 1), 0)::DOUBLE", 9)}
                          AS graph_density
               FROM degrees""",
            "degrees", graph=PAGES,
        ),
        "components": _query(
            f"""SELECT repo_id, components AS num_connected_components,
                      {_exact("largest::DOUBLE / nodes", 9)} AS largest_component_fraction
               FROM component_counts JOIN degrees USING (repo_id)""",
            "component_counts", "degrees", graph=CODE,
        ),
        "components_contracted": _query(
            f"""SELECT repo_id, components AS num_connected_components,
                      {_exact("largest::DOUBLE / nodes", 9)} AS largest_component_fraction
               FROM component_counts JOIN degrees USING (repo_id)""",
            "component_counts", "degrees", graph=CODE,
        ),
        "page_components": _query(
            f"""SELECT repo_id, components AS num_connected_components,
                      {_exact("largest::DOUBLE / nodes", 9)} AS largest_component_fraction
               FROM component_counts JOIN degrees USING (repo_id)""",
            "component_counts", "degrees", graph=PAGES,
        ),
        "dependency_score": _query(
            f"SELECT {_METRIC_COLUMNS} FROM metrics", "metrics", graph=CODE
        ),
        "page_score": _query(f"SELECT {_METRIC_COLUMNS} FROM metrics", "metrics", graph=PAGES),
        "result_rounding": f"""
            SELECT o_orderkey, {_exact("ratio", 4)} AS four_places,
                   {_exact("NULLIF(ratio, 0)", 6)} AS six_places
            FROM (SELECT o_orderkey,
                         (o_orderkey % 401)::DOUBLE / (1 + o_custkey % 400)::DOUBLE AS ratio
                  FROM orders)""",
        # outcomes
        "repo_outcomes": outcomes,
        "run_summary": f"""SELECT processing_status, COUNT(*) AS repos FROM ({outcomes})
            GROUP BY processing_status""",
        "run_progress": f"""
            WITH rows AS MATERIALIZED ({outcomes}),
                 counts AS (
                     SELECT (SELECT COUNT(*) FROM supplier WHERE s_suppkey % 3 = 0) AS already_done,
                            (SELECT COUNT(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS to_process,
                            (SELECT COUNT(*) FROM rows
                             WHERE processing_status <> 'github_api_failed'
                                   AND COALESCE(error_message, '') NOT LIKE 'size_kb=%')
                                AS candidates,
                            (SELECT COUNT(*) FROM rows WHERE processing_status = 'completed')
                                AS passed)
            SELECT 'already_done' AS measure, already_done AS repos FROM counts
            UNION ALL SELECT 'to_process', to_process FROM counts
            UNION ALL SELECT 'candidates', candidates FROM counts
            UNION ALL SELECT 'filtered', to_process - candidates FROM counts
            UNION ALL SELECT 'passed', passed FROM counts""",
        "status_lookup": f"""SELECT repo_id, full_name, error_message FROM ({outcomes})
            WHERE processing_status IN ('skipped', 'error')""",
        "stored_results": outcomes,
        "stored_constraints": f"""
            WITH stored AS ({outcomes})
            SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
            SELECT 'unique repo_id' AS rule, COUNT(*) - COUNT(DISTINCT repo_id) AS violations FROM stored
            UNION ALL SELECT 'not null full_name', COUNT_IF(full_name IS NULL) FROM stored
            UNION ALL SELECT 'not null url', COUNT_IF(url IS NULL) FROM stored
            UNION ALL SELECT 'not null dependency_score', COUNT_IF(dependency_score IS NULL) FROM stored
            UNION ALL SELECT 'not null ' || c, 0
            FROM (VALUES ('id'), ('repo_id'), ('github_size_kb'), ('total_code_tokens'), ('total_code_files'),
                         ('total_code_bytes'), ('internal_import_count'), ('unique_internal_imports'),
                         ('processing_status'), ('processed_at')) names(c))""",
        "incremental_run": _outcomes("TRUE"),
        "result_constraints": _query(
            """SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
                 SELECT 'unique repo_id' AS rule,
                        COUNT(*) - COUNT(DISTINCT id) AS violations FROM dirty
                 UNION ALL SELECT 'not null full_name', COUNT_IF(full_name IS NULL) FROM dirty
                 UNION ALL SELECT 'not null url', COUNT_IF(url IS NULL) FROM dirty
                 UNION ALL SELECT 'not null ' || c, 0
                 FROM (VALUES ('id'), ('repo_id'), ('github_size_kb'), ('total_code_tokens'),
                              ('total_code_files'), ('total_code_bytes'), ('dependency_score'),
                              ('internal_import_count'), ('unique_internal_imports'),
                              ('processing_status'), ('processed_at')) names(c))""".replace(
                "FROM dirty",
                """FROM (SELECT id, full_name, url FROM repos
                         UNION ALL SELECT id, full_name, url FROM repos WHERE k % 4 = 0) dirty""",
            ),
            "repos",
        ),
        "upsert_latest": _query(
            """SELECT COALESCE(u.id, e.id) AS repo_id,
                      COALESCE(u.status, e.status) AS processing_status,
                      CASE WHEN u.status IS NULL OR u.status <> 'completed' THEN e.density
                           ELSE u.density END AS graph_density,
                      COALESCE(u.tokens, e.tokens) AS total_code_tokens,
                      CASE WHEN u.status IS NULL OR u.status = 'completed' THEN e.message
                           ELSE u.message END AS error_message,
                      COALESCE(e.seen, u.seen) AS first_seen
               FROM (SELECT id, CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'error' END AS status,
                            CASE WHEN k % 2 = 0 THEN k / 1000.0::DOUBLE END AS density,
                            k * 10 AS tokens,
                            CASE WHEN k % 2 = 1 THEN 'first ' || k END AS message, 1 AS seen
                     FROM repos WHERE k % 3 <> 0) e
               FULL JOIN
                    (SELECT id, CASE WHEN k % 5 < 3 THEN 'completed' ELSE 'skipped' END AS status,
                            CASE WHEN k % 5 < 3 THEN (k + 1) / 1000.0::DOUBLE END AS density,
                            k * 20 + 1 AS tokens,
                            CASE WHEN k % 5 >= 3 THEN 'second ' || k END AS message, 3 AS seen
                     FROM repos WHERE k % 4 <> 0) u
               ON e.id = u.id""",
            "repos",
        ),
        # serving
        "topk_score": _query(
            f"""SELECT repo_id, {_exact("score", 4)} AS dependency_score FROM metrics
                ORDER BY 2 DESC, 1 LIMIT 20""",
            "metrics", graph=PAGES,
        ),
        "topk_tokens": _query(
            """SELECT repo_id, total_tokens FROM document_totals
               ORDER BY total_tokens DESC, repo_id LIMIT 10""",
            "document_totals",
        ),
        "score_buckets": _query(
            f"""SELECT CAST(bucket AS INTEGER) AS bucket, COUNT(*) AS repos,
                       MIN(score) AS lowest, MAX(score) AS highest
                FROM (SELECT {_exact("score", 4)} AS score,
                             CASE WHEN {_exact("score", 4)} >= 0.75 THEN 3
                                  WHEN {_exact("score", 4)} >= 0.5 THEN 2
                                  WHEN {_exact("score", 4)} >= 0.25 THEN 1 ELSE 0 END AS bucket
                      FROM metrics)
                GROUP BY bucket""",
            "metrics", graph=PAGES,
        ),
        "score_buckets_quantile": _query(
            """SELECT CAST(bucket AS INTEGER) AS bucket, COUNT(*) AS files,
                      CAST(MIN(tokens) AS DOUBLE) AS lowest, CAST(MAX(tokens) AS DOUBLE) AS highest
               FROM (SELECT tokens, (SELECT COUNT(DISTINCT edge) FROM
                       (SELECT MIN(tokens) AS edge, p FROM
                          (SELECT tokens, ROW_NUMBER() OVER (ORDER BY tokens) AS r, COUNT(*) OVER () AS n
                           FROM document_tokens WHERE tokens IS NOT NULL),
                          (VALUES (0.25), (0.5), (0.75)) AS shares(p)
                        WHERE r >= p * n GROUP BY p) WHERE edge <= d.tokens) AS bucket
                     FROM document_tokens d)
               GROUP BY bucket""",
            "document_tokens",
        ),
        "mixture_sample": _query(
            """SELECT repo_id, path, length_bucket FROM (
                 SELECT repo_id, path,
                        CASE WHEN tokens >= 1000 THEN 2 WHEN tokens >= 100 THEN 1 ELSE 0 END
                            AS length_bucket,
                        CAST('0x' || SUBSTR(MD5('7:' || repo_id || '/' || path), 1, 8) AS BIGINT)
                            % 10000 AS position
                 FROM document_tokens)
               WHERE position < CASE length_bucket WHEN 2 THEN 9000 WHEN 1 THEN 5000
                                     ELSE 1000 END""",
            "document_tokens",
        ),
        "mixture_tokens": _query(
            """SELECT * FROM (WITH placed AS (
                 SELECT repo_id, path, tokens,
                        CASE WHEN tokens >= 120 THEN 2 WHEN tokens >= 60 THEN 1 ELSE 0 END
                            AS length_bucket,
                        CAST('0x' || SUBSTR(MD5('7:' || repo_id || '/' || path), 1, 8) AS BIGINT)
                            % 10000 AS position
                 FROM document_tokens),
               weights(length_bucket, weight) AS (VALUES (0, 1), (1, 3), (2, 2)),
               sums AS (
                 SELECT p.length_bucket, position, weight,
                        SUM(SUM(tokens)) OVER (PARTITION BY p.length_bucket ORDER BY position) AS upto,
                        SUM(SUM(tokens)) OVER (PARTITION BY p.length_bucket) AS total
                 FROM placed p JOIN weights w USING (length_bucket) GROUP BY 1, 2, 3),
               scarce AS (SELECT total, weight FROM sums WHERE total > 0
                          ORDER BY total / weight, length_bucket LIMIT 1),
               cuts AS (SELECT length_bucket, MAX(position) AS last FROM sums
                        WHERE upto * (SELECT weight FROM scarce) <= (SELECT total FROM scarce) * weight
                        GROUP BY 1)
               SELECT repo_id, path, length_bucket FROM placed JOIN cuts USING (length_bucket)
               WHERE position <= last)""",
            "document_tokens",
        ),
        # corpus
        "corpus_json": "SELECT text FROM conversations",
        "corpus_text": r"""SELECT REGEXP_REPLACE(text, '[\r\n]+', ' ', 'g') AS text
            FROM conversations""",
        "corpus_tokenize": f"""
            SELECT ARRAY_TO_STRING(ids, ' ') AS input_ids, CAST(LEN(ids) AS INTEGER) AS n_tokens
            FROM (SELECT LIST_SLICE(REGEXP_EXTRACT_ALL(text, '{TOKENS}'), 1, 64) AS ids
                  FROM conversations)""",
        "corpus_stats": "SELECT COUNT(*) AS examples FROM conversations",
        "corpus_export": _query(
            r"""SELECT REGEXP_REPLACE(text, '\r\n?', CHR(10), 'g') AS text
                FROM document_files
                WHERE doc_id % 7 IN (0, 1, 3) AND size_bytes BETWEEN 1 AND 1000000
                      AND repo_id IN (SELECT repo_id FROM document_totals
                                      WHERE total_tokens >= """
            + f"{MIN_TOKENS_DOCUMENTS})",
            "document_files", "document_totals",
        ),
    }
