"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Median of three warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from trailmill.plans import bench_inputs, catalog  # noqa: E402

HEADLINE = [
    "gap_classify", "lane_intervals", "tracking_sessions", "session_bounds", "pair_balance", "consume_pairs", "episode_collapse", "flush_outcome", "heartbeat_cadence",
    "locate_placed_tethered", "range_count_60s", "track_polyline", "marker_dedupe", "dedup_groups", "shape_groups", "vocab_candidates", "vocab_drift", "redact_text", "parse_rendered_log", "payload_location",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    qs, seconds = catalog.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            t = time.perf_counter()
            run(qs[name](spark, sf))
            times.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(times[1:]), 3)
    # the one floor that is published: records classified per second, 1,000 entries, two-line records
    n = 200_000
    recs = bench_inputs.synthetic_records(spark, n).cache()
    recs.count()
    times = []
    for _ in range(3):
        t = time.perf_counter()
        run(bench_inputs.classified(recs))
        times.append(time.perf_counter() - t)
    rate = n / statistics.median(times)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "classified_records_per_sec": round(rate)}))


if __name__ == "__main__":
    main()
