"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query runs once
to warm up and once timed; all rows are consumed.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "search_filtered_rerank",
    "search_filter_per_query",
    "maxsim_scores",
    "best_chunks_per_paper",
    "triplet_mining",
    "chunk_context",
    "sentence_split",
    "block_margin_filter",
    "reference_section",
    "merge_full_outer",
    "dedupe_by_title",
    "payload_filter_fields",
    "citation_edges",
    "result_cleanup",
    "running_words",
    "last_pair",
    "requests_in_progress",
    "latency_histogram",
    "stalled_requests",
    "chained_semi_join",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from paperloom import build_session
    from paperloom.plans import QUERIES

    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("bench", master=f"local[{cpus}]", **settings)
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
