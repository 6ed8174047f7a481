"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rangescan.queries import QUERIES

HEADLINE = [
    "range_image_max", "unproject_points", "spherical_bins", "repair_depth_sequential", "smooth_angles_5", "ground_removed", "diff_angle", "labels_angle", "labels_simple",
    "labels_step2", "labels_native", "cluster_points", "size_filter", "bbox", "bbox_intersections", "object_hull", "segmentation", "transform_points", "nearest_odometry", "asof_odometry",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["labels_angle"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler and the Python workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
