"""Headline queries, timed. One JSON line:

    {"metric": "...", "value": total seconds, "unit": "sec", "queries": {name: sec}, "sf": ...}

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3). Times are medians over the runs;
"jobs" counts the Spark jobs of one run.
Facts shared between queries are forgotten before each run, so every timing does its own work."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINES = (
    "rec_full_events", "prf_08_numeric_stats_lineitem", "prf_09_top_categories", "dst_02_exact_duplicates",
    "dst_05_pearson_matrix", "dst_07_cramers_v", "qlt_d_repair_log", "qlt_r_replay_all", "sco_01_health",
    "rec_08_winsorize", "rec_09_standard", "rec_14_onehot", "pip_04_train_statistics", "tgt_04_mutual_information",
    "viz_02_grouped", "viz_03_missingness_grid", "dif_01_cell_status",
)


def main() -> None:
    from pyspark.sql import SparkSession
    from quern.plans import queries as Q
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, list[float]] = {name: [] for name in HEADLINES}
    jobs: dict[str, int] = {}
    for run in range(max(1, RUNS)):
        for name in HEADLINES:
            Q._memo.clear()
            spark.sparkContext.setJobGroup(f"{name}-{run}", name)
            start = time.perf_counter()
            Q.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - start)
            jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{run}"))
    medians = {name: round(statistics.median(t), 3) for name, t in times.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(medians.values()), 3), "unit": "sec",
                      "queries": medians, "jobs": jobs, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
