"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import time


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("vacatlas-bench")
             .config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import checks
    names = ["e02_language_level", "e06_salary", "e07_relevance", "e10_skills", "f16_gate_chain",
             "m09_total", "d08_components", "d01_resolve", "g01_worth_applying", "i01_upsert",
             "a01_headline", "a12_coverage_buckets", "t01_newest", "t05_board", "i12_saved_searches",
             "w05_status_timeline", "w07_failure_streaks", "n13_clean_html", "q03_secrets", "s04_greenhouse"]
    checks.QUERIES["f10_usable"](spark, sf).count()  # start the session's workers
    spent = {}
    for name in names:
        t = time.time()
        checks.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
