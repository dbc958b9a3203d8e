"""The registered queries in SQL, where SQL can express them."""

from __future__ import annotations

_OP2 = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS w
  FROM item_words, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i)
  WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM doc_words, sizes, unnest(range(1, len(ws) - k + 2)) AS t(i)
), hits AS (
  SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, w)
), hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


_OP4 = r"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts),
triples AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM split, unnest(range(1, len(ws) - 1)) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM repeated, unnest(range(i, i + 3)) AS t(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), dups AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT s.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), long AS (
  SELECT doc_id, lang, source, unnest([
    {'m': 'symbols', 'v': n_symbols * 1000 // greatest(n_words, 1), 'slack': 30},
    {'m': 'word_length', 'v': word_chars * 1000 // greatest(n_words, 1), 'slack': 500},
    {'m': 'dup_lines', 'v': n_dup_lines * 1000 // greatest(n_words, 1), 'slack': 60},
    {'m': 'repeats', 'v': n_repeat_words * 1000 // greatest(n_words, 1), 'slack': 100}], recursive := true), n_words
  FROM base
), binned AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS b FROM long
), ranked AS (
  SELECT lang, source, m, slack, b, row_number() OVER (PARTITION BY lang, source, m ORDER BY b) AS r,
    count(*) OVER (PARTITION BY lang, source, m) AS total
  FROM binned WHERE n_words > 0
), quartiles AS (
  SELECT lang, source, m, any_value(slack) AS slack,
    min(b) FILTER (r * 4 >= total) AS q1, min(b) FILTER (r * 4 >= total * 3) AS q3
  FROM ranked GROUP BY ALL
), outside AS (
  SELECT DISTINCT doc_id FROM binned x JOIN quartiles q
  ON x.m = q.m AND x.lang IS NOT DISTINCT FROM q.lang AND x.source IS NOT DISTINCT FROM q.source
  WHERE v < q1 - 3 * (q3 - q1) - q.slack OR v > q3 + 3 * (q3 - q1) + q.slack
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM base
"""

_OP1 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS w
  FROM split, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
)
SELECT r.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept
FROM reach r LEFT JOIN sizes s USING (doc_id) GROUP BY r.doc_id
"""


_OP7 = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS w
  FROM split, unnest(range(1, len(ws) - 48)) AS t(i)
), newer AS (
  SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY w)
), gone AS (
  SELECT DISTINCT doc_id, j FROM newer, unnest(range(i, i + 50)) AS t(j)
), words AS (
  SELECT doc_id, ws[j] AS w, j FROM split, unnest(range(1, len(ws) + 1)) AS t(j)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": _OP1, "op2_decontaminate": _OP2, "op7_substring_dedup": _OP7, "op4_quality_rules": _OP4}

