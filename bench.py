"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 2: the first run of each query warms up, the best of the rest counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from repoloom.plans import registry  # noqa: E402
from repoloom.session import build_session  # noqa: E402

HEADLINES = (
    "token_count",
    "token_totals",
    "tokens_by_ext",
    "py_imports",
    "js_imports",
    "path_normalize",
    "py_resolve",
    "graph_nodes_edges",
    "in_degree",
    "components",
    "components_contracted",
    "dependency_score",
    "page_score",
    "topk_score",
    "repo_outcomes",
    "upsert_latest",
    "mixture_sample",
    "corpus_tokenize",
    "corpus_export",
)


def timed(query, spark, sf_dir: str) -> float:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = registry.queries()
    seconds = {}
    for name in HEADLINES:
        times = [timed(queries[name], spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(min(times[1:] or times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
