"""Times the headline queries and prints one JSON line. Usage: BENCH_SF_DIR=... BENCH_CPUS=... python bench.py"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINES = ["zonal_basic", "temporal_p95", "components", "hist_match", "point_sample", "glcm_contrast", "classify_centroid", "zonal_all", "dem_slope", "mosaic_last"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quadrille import catalog

    def once(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took = {}
    for name in HEADLINES:
        once(name)  # compiles
        took[name] = round(statistics.median(once(name) for _ in range(3)), 3)
    print(json.dumps({"metric": "median seconds of the headline queries, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
