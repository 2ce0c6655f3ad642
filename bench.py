"""Times the headline queries; prints one JSON line.

Every query runs once to warm up and then ``BENCH_RUNS`` times (3 by default, once if the
warm-up took over 8 seconds) into a sink that keeps nothing; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = (
    "f4_canonical_url", "f15_page_links", "f12_main_text", "p5_link_relevance", "j7_keyword_match", "f32_total_score",
    "j9_title_similarity", "a9_near_duplicates", "c4_candidates", "f20_events_in_window_daily", "a1_daily_counts",
    "a1_events_daily", "a2_distribution_returnflag", "a18_share_of_total", "j4_orders_lineitem_merge",
    "j4_metadata_merge", "u4_reported_by_day", "w2_interleave", "w5_history_items", "m1_with_generated",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = wanted.split(",") if wanted else HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pressmill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # small inputs are split over all cores
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pressmill.queries import QUERIES

    times = {}
    for name in names:
        def once() -> float:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        warm_up = once()
        # long jobs are steady enough for a single timed run
        times[name] = round(statistics.median([once() for _ in range(runs if warm_up < 8 else 1)]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
