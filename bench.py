"""Times the headline queries (median of three runs) and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS:   cores of the local session (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pickwell import get_session
from registry.queries import QUERIES

HEADLINE = (
    "vector_topk", "vector_topk_blocks", "text_topk", "hash_encode", "build_index",
    "pages_to_catalog", "crawl_catalog", "catalog_merge", "link_extract", "page_body_text",
    "classify_documents", "duration_full", "url_normalize",
    "topk_with_meta", "recommend", "response_nested", "batch_export", "recall_at_k",
)


RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-checkpoint-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start Python workers and compile the first plan outside the measurement
    QUERIES["hash_encode"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
