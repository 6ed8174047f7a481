"""Points to range images and back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangescan.plans.sensor import Sensor, col_of, row_of

#: Points nearer than this, in metres, are not projected; depths below it are holes.
LEAST_DISTANCE, LEAST_DEPTH, HOLE = 0.01, 0.0001, 0.001


def distance_3d(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def distance_2d(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def binned(points: DataFrame, sensor: Sensor, mode: str = "spherical") -> DataFrame:
    """Points with the row, column and distance of their pixel.

    ``spherical``: row and column from the direction, out-of-view directions go to the nearest edge.
    ``ring``: the row is the ring, the distance that in the plane; rings the sensor lacks are left out.
    """
    if {"row", "col"} & set(points.columns):
        raise ValueError("projection is already initialized")
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    if mode == "spherical":
        near = points.withColumn("dist", distance_3d(x, y, z)).where(F.col("dist") >= LEAST_DISTANCE)
        return near.withColumn("row", row_of(F.asin(z / F.col("dist")), sensor)).withColumn("col", col_of(F.atan2(y, x), sensor))
    if mode == "ring":
        near = points.withColumn("dist", distance_2d(x, y)).where((F.col("dist") >= LEAST_DISTANCE) & F.col("ring").between(0, sensor.rows - 1))
        return near.withColumn("row", F.col("ring").cast("int")).withColumn("col", col_of(F.atan2(y, x), sensor))
    raise ValueError(f"no projection named {mode!r}")


def to_pixels(binned_points: DataFrame) -> DataFrame:
    """(frame_id, row, col, depth, n_points): the farthest return of each pixel."""
    return binned_points.groupBy("frame_id", "row", "col").agg(F.max("dist").alias("depth"), F.count("*").alias("n_points"))


def project(points: DataFrame, sensor: Sensor, mode: str = "spherical") -> tuple[DataFrame, DataFrame]:
    """Range image (frame_id, row, col, depth) and the pixel of each point (frame_id, point_idx, row, col)."""
    placed = binned(points, sensor, mode)
    pixels = to_pixels(placed).drop("n_points")
    if mode == "spherical" and len(sensor.corrections) == sensor.rows:
        pixels = correct(pixels, sensor)
    return pixels, placed.select("frame_id", "point_idx", "row", "col")


def correct(pixels: DataFrame, sensor: Sensor) -> DataFrame:
    """Take the sensor's error of the row off every depth that is not a hole."""
    table = F.broadcast(sensor.row_table(pixels.sparkSession).select("row", "correction"))  # one line a row
    return pixels.join(table, "row", "left").withColumn("depth", F.when(F.col("depth") >= HOLE, F.col("depth") - F.coalesce("correction", F.lit(0.0))).otherwise(F.col("depth"))).drop("correction")


def unproject_xyz(depth: Column, row_cos: Column, row_sin: Column, col_cos: Column, col_sin: Column) -> list[Column]:
    return [(depth * row_cos * col_cos).alias("x"), (depth * row_cos * col_sin).alias("y"), (depth * row_sin).alias("z")]


def unproject(pixels: DataFrame, sensor: Sensor, keep_holes: bool = False) -> DataFrame:
    """A point for every pixel with a depth: (frame_id, point_idx, x, y, z, ring, row, col, depth).

    The ring is the row; point_idx is the pixel's place, row by row. ``keep_holes`` gives holes a point too.
    """
    seen = pixels.where(F.col("row").between(0, sensor.rows - 1) & F.col("col").between(0, sensor.cols - 1))
    seen = seen if keep_holes else seen.where(F.col("depth") >= LEAST_DEPTH)
    # sines and cosines are constants of the plan, one for each row or column of the sensor
    table = [F.get(F.lit([f(a) for a in angles]), F.col(c)) for c, angles in (("row", sensor.row_angles), ("col", sensor.col_angles)) for f in (math.cos, math.sin)]
    xyz = unproject_xyz(F.col("depth").cast("double"), *table)
    return seen.select("frame_id", (F.col("row").cast("long") * sensor.cols + F.col("col")).alias("point_idx"), *xyz, F.col("row").alias("ring"), "row", "col", "depth")


def points_of_pixel(points: DataFrame, point_pixel: DataFrame, row: int, col: int) -> DataFrame:
    """Points projected to a pixel."""
    return points.join(point_pixel.where((F.col("row") == row) & (F.col("col") == col)), ["frame_id", "point_idx"])


def checked_image(pixels: DataFrame, sensor: Sensor) -> DataFrame:
    """Pixels, or an error when one lies outside the sensor's image."""
    inside = F.col("row").between(0, sensor.rows - 1) & F.col("col").between(0, sensor.cols - 1)
    return pixels.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("image size doesn't match the projection parameters")).cast("boolean")))


def checked_points(points: DataFrame) -> DataFrame:
    if points.isEmpty():
        raise ValueError("cannot fill from cloud: no points")
    return points


def dense(pixels: DataFrame, sensor: Sensor) -> DataFrame:
    """Column arrays (frame_id, col, depths): one value a row, 0 where there is no return; every column of every frame."""
    cells = pixels.groupBy("frame_id", "col").agg(F.map_from_entries(F.collect_list(F.struct("row", "depth"))).alias("cells"))  # at most one a row
    frames = pixels.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(sensor.cols - 1))).alias("col"))
    depths = F.transform(F.sequence(F.lit(0), F.lit(sensor.rows - 1)), lambda r: F.coalesce(F.try_element_at(F.col("cells"), r).cast("double"), F.lit(0.0)))
    return frames.join(cells, ["frame_id", "col"], "left").select("frame_id", "col", depths.alias("depths"))


def sparse(columns: DataFrame, *arrays: str) -> DataFrame:
    """Rows (frame_id, row, col, ...) of column arrays."""
    zipped = columns.select("frame_id", "col", F.posexplode(F.arrays_zip(*arrays)).alias("row", "cell"))
    return zipped.select("frame_id", "row", "col", *(F.col(f"cell.{a}").alias(a) for a in arrays))
