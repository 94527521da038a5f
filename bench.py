"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from scanloom.session import build_session
from scanloom.workloads import catalog

HEADLINE = [
    "a5_repository_scores", "w1_lines", "j1_config_rules", "d2_secret_rules", "w10_chunk_files", "w6_greedy_packs", "o2_top_packs",
    "a6_dependencies", "j3_declaring_file", "a8_dedupe_merge", "a8_dedupe_hot_keys", "u2_reduced_and_derived", "a5_scan_scores",
    "a9_history_entries", "w8_repository_summary", "r1_final_states", "r2_change_feed", "j12_outermost_spans", "f5_parse_responses",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start-up is not part of any query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
