"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query first runs at the smallest scale next to $BENCH_SF_DIR, which loads code and
starts the Python workers, and is then timed over `BENCH_RUNS` runs (best counts), with
its full result consumed by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpusengine.plans.catalog import QUERIES
from corpusengine.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "normalize_text",
    "pii_mask",
    "fallback_keywords",
    "hierarchy_topics",
    "recursive_chunks",
    "context_window",
    "exact_dedup",
    "minhash_signature",
    "clean_documents",
    "near_dedup",
    "knn_l2",
    "knn_by_section",
    "bm25_search",
    "hybrid_search",
    "short_term_memory",
    "stage_latency",
    "normalized_sections",
]

#: Timed once each and reported beside the headline; not part of its sum.
MORE = [
    "ivf_exact",
    "ann_lsh_tables",
    "route_named",
    "rerank_model",
    "keyword_answers",
    "long_term_memory",
    "upsert_versions",
    "index_updates",
    "turn_rows",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed(spark, names: list[str], runs: int) -> dict[str, float]:
    """Best time of each query after a run at the smallest scale."""
    seconds = {}
    for name in names:
        if os.path.isdir(WARM_DIR):
            run(spark, name, WARM_DIR)
        times = [run(spark, name, SF_DIR) for _ in range(runs)]
        seconds[name] = round(min(times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    return seconds


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark_sql_shuffle_partitions=CPUS,
        spark_ui_enabled="false",
        spark_driver_memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = timed(spark, sys.argv[1:] or HEADLINE, RUNS)
    more = timed(spark, [] if sys.argv[1:] else MORE, 1)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "more": more,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
