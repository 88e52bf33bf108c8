"""Seconds per headline query: median of BENCH_RUNS (2) after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelgraph.plans.queries import QUERIES
from reelgraph.session import local_session

HEADLINE = (
    "best_usable_frames",
    "frames_in_sections",
    "quality_gate",
    "duplicate_pairs",
    "near_duplicate_groups",
    "rank_frames",
    "best_section_per_frame",
    "top_n_display",
    "resolve_selection",
    "candidate_timestamps",
    "extract_sentences",
    "model_context",
    "validate_query_graph",
    "usage_rollup",
    "catalogue_page",
    "latest_state",
    "scene_relations",
    "frame_signals",
    "match_nodes",
    "match_score",
    "render_markdown",
    "seeded_split",
    "image_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, app="reelgraph-bench", shuffle_partitions=str(int(cpus) * 2)
                          if cpus.isdigit() else "16")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
