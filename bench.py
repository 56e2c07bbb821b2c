"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, comma-separated).
Every query computes all its columns (a noop write). Each runs once on the smallest tables first, so that class loading
and Python worker start are not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusflow.plans.queries import QUERIES  # noqa: E402
from corpusflow.session import build_session  # noqa: E402

HEADLINE = (
    "chunk_documents",
    "chunk_overlap_zero",
    "chunk_overlap_fifty",
    "chunk_conversation_pages",
    "html_text",
    "html_chunks",
    "plain_text",
    "csv_text",
    "serialise_customer",
    "table_chunks",
    "table_chunks_large",
    "hash_embedding",
    "vector_ids",
    "knn_l2",
    "search_chunks",
    "chunk_jsonl_roundtrip",
    "document_meta",
    "run_summary",
    "get_document",
    "delete_survivors",
    "drive_manifest",
    "last_write_wins",
    "ingest_directory",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = f"{os.path.dirname(folder)}/sf0.001"
    seconds = {}
    for name in names:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(folder).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
