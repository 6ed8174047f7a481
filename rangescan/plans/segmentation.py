"""The whole plan: points to range image, ground off, labels, clusters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.operators.cluster import cluster
from rangescan.operators.ground import remove_ground
from rangescan.operators.labels import label_image
from rangescan.operators.project import binned, to_pixels
from rangescan.plans.sensor import Sensor


@dataclass(frozen=True)
class Settings:
    """Angles in degrees; defaults are those of the command line for binary scans."""

    separation: float = 10.0
    ground: float = 7.0
    window: int = 9
    min_size: int = 20
    max_size: int = 100_000
    diff: str = "angle"
    mode: str = "spherical"
    #: 16-bit size limits and the dilation offsets of a mistyped kernel
    compat: bool = False


def segment(points: DataFrame, sensor: Sensor, settings: Settings | None = None) -> DataFrame:
    """Labelled points (frame_id, row, col, label, point_idx, x, y, z, ring, dist) of all objects of points (frame_id, point_idx, x, y, z, ring)."""
    s = settings or Settings()
    placed = binned(points, sensor, s.mode)
    pixels = to_pixels(placed).select("frame_id", "row", "col", "depth")
    bare = remove_ground(pixels, sensor, s.ground, s.window, s.compat).where(F.col("depth") > 0)
    labels = label_image(bare, sensor, s.diff, math.radians(s.separation))
    return cluster(placed, placed, labels, s.min_size, s.max_size, s.compat)
