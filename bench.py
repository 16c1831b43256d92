"""Seconds of the headline queries, the median of three warm runs; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from sparktide.plans.queries import QUERIES

HEADLINE = ["downsample_fill", "count_sum_avg", "first_last_value", "mode", "count_if_ge", "window_tumbling_empty", "window_sliding", "window_month", "window_session", "window_condition", "window_count", "window_variation_equal", "window_variation_delta", "fill_linear_midpoint", "last_query", "m4", "mvavg", "zscore", "iqr", "ksigma", "resample", "median_mad", "cov_pearson", "group_by_tags", "wide_to_narrow", "acf", "fft_round_trip", "fill_previous", "time_range", "sql_align_by_time", "udaf_square_mean"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
