"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "gap_decisions", "gap_decisions_strict", "cdc_output", "cdc_output_strict", "gap_counters", "gap_fill_episodes",
    "fill_commands", "fill_lookup_left", "fill_lookup_inner", "tagged_union_input", "json_decode_quarantine",
    "current_state", "materialized_image", "change_capture", "replay_gaps", "outage_windows", "retry_schedule",
    "gap_limits", "gap_stream_equals_batch",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from mendline.plans.catalog import QUERIES
    from mendline.sources import io

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}

    def run(name: str) -> None:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        io.release(spark)

    run("gap_decisions")  # start-up of the session is not part of any query
    for name in names:
        best = float("inf")
        for _ in range(1 if "stream" in name else 3):
            start = time.perf_counter()
            run(name)
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "events_per_sec": {n: round(events / seconds[n]) for n in ("gap_decisions", "gap_stream_equals_batch") if n in seconds},
    }))


if __name__ == "__main__":
    main()
