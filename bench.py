"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablelink.plans.queries import QUERIES  # noqa: E402
from tablelink.session import local_session  # noqa: E402

HEADLINE = (
    "run_weighted_f1",
    "report",
    "compare_three",
    "hard_cases",
    "gold_ids",
    "mention_places",
    "row_text",
    "cells_from_files",
    "meta_missing_running",
    "candidate_text",
    "kb_lookup_topk",
    "retrieval_replace",
    "json_texts",
    "prompt_title_cand_wiki",
    "link_run",
    "sft_length_hist",
    "sft_padded",
)


def run(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, folder)
        seconds[name] = round(
            statistics.median(run(QUERIES[name], spark, folder) for _ in range(repeats)), 3
        )
    print(
        json.dumps(
            {
                "metric": "median seconds per query, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
