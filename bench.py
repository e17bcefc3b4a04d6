"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of local cores,
BENCH_SHARED_DIR the folder for staged data.
Each query runs `BENCH_RUNS` times (2) into a sink that discards the rows; the
shortest run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoal.plans.queries import QUERIES  # noqa: E402
from shoal.session import build_session, clear_scratch  # noqa: E402

HEADLINE = (
    "import_records",
    "rejected_counts",
    "import_limit",
    "metadata_all",
    "stream_import",
    "batch_sizes",
    "upsert_records",
    "content_dedupe",
    "add_records",
    "stored_records",
    "collection_summary",
    "resolve_or_input",
    "tokenize_documents",
    "encode_tokens",
    "hashing_embed_documents",
    "embed_documents_in_workers",
    "knn_l2",
    "blocked_knn",
    "text_query",
    "query_response_nested",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "shoal-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="shoal-bench-"),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        clear_scratch(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
