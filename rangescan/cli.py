"""Segment a folder of scans: python -m rangescan.cli --path scans --format bin --num_beams 64 --out objects"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from rangescan.plans.segmentation import Settings, segment
from rangescan.plans.sensor import Sensor
from rangescan.sources.scans import read_scans
from rangescan.sources.sinks import save_clusters


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--path", required=True, help="folder of scans")
    parser.add_argument("--format", default="bin", choices=["bin", "txt", "pcd", "png"])
    parser.add_argument("--angle", type=float, default=10.0, help="separation angle in degrees")
    parser.add_argument("--num_beams", type=int, default=64, choices=[16, 32, 64])
    parser.add_argument("--config", help="sensor file instead of --num_beams")
    parser.add_argument("--every", type=int, default=1, help="save every n-th frame")
    parser.add_argument("--out", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("rangescan").getOrCreate()
    sensor = Sensor.from_config(given.config) if given.config else Sensor.preset(given.num_beams)
    began = time.perf_counter()
    points = read_scans(spark, given.path, given.format, sensor).drop("row", "col", "depth")
    save_clusters(segment(points, sensor, Settings(separation=given.angle)), given.out, given.every)
    print(f"{time.perf_counter() - began:.1f} s")


if __name__ == "__main__":
    main()
