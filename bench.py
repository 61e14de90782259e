"""Times the headline queries: one JSON line with seconds a query and their sum. Each query runs once to warm up and once timed."""

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from banditframe.plans import catalog

HEADLINE = ["flagship_curves", "p11_where_any", "j6_where_result", "a1_group_count", "a21_filter_fin", "w1_progressive_mean", "w5_exponential_mean", "o8_best", "t2_raw_contrast_j8", "r2_scale_minmax", "r3_impute_mean", "e4_epsilon_greedy_w9", "e10_ips_score", "r17_doubly_robust", "m5_to_m9_information", "s10_k2_result_log"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, found = {}, catalog.queries()
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
