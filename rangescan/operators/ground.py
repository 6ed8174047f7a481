"""Ground removal on range images.

Hole repair, slopes and smoothing run down one column of the image at a time and need nothing else,
so each is an expression over the column's array: one projection, no exchange. The flood fill needs
the whole frame and is a kernel behind the exchange by frame.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangescan.functions.diff import diff
from rangescan.operators.labels import grid_edges, roots
from rangescan.operators.project import HOLE, dense, sparse
from rangescan.plans.sensor import Sensor

#: Smoothing weights by window size, with their common divisor.
SMOOTHING = {
    5: ([-3, 12, 17, 12, -3], 35),
    7: ([-2, 3, 6, 7, 6, 3, -2], 21),
    9: ([-21, 14, 39, 54, 59, 54, 39, 14, -21], 231),
    11: ([-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36], 429),
}
#: Rows that hole repair looks up and down, and how far the ends may differ, in metres.
REPAIR_STEP, REPAIR_DEPTH = 5, 1.0
#: Steepest slope of a pixel that the flood starts from.
SEED_ANGLE = math.radians(30)


def smoothing_kernel(window: int) -> list[float]:
    if window % 2 == 0:
        raise ValueError("only odd window size allowed")
    if window not in SMOOTHING:
        raise ValueError("bad window size")
    weights, divisor = SMOOTHING[window]
    return [w / divisor for w in weights]


def uniform_kernel(window: int) -> list[float]:
    """Half the value at either end."""
    if window % 2 == 0:
        raise ValueError("only odd window size allowed")
    return [0.5, *[0.0] * (window - 2), 0.5]


def repaired(depths: Column, rows: int, step: int = REPAIR_STEP, threshold: float = REPAIR_DEPTH) -> Column:
    """Column array with holes filled from the pairs of returns above and below that agree.

    Goes down the column; returns above are taken as already repaired.
    """

    def fill(done: Column, r: Column) -> Column:
        depth = F.get(depths, r)
        ups = [F.get(done, r - i) for i in range(1, step)]
        downs = [F.get(depths, r + j) for j in range(1, step)]
        total, count = F.lit(0.0), F.lit(0)
        for up in ups:
            for down in downs:
                fits = F.coalesce((up > HOLE) & (down > HOLE) & (F.abs(up - down) < threshold), F.lit(False))
                total += F.when(fits, up + down).otherwise(0.0)
                count += F.when(fits, 2).otherwise(0)
        return F.concat(done, F.array(F.when((depth < HOLE) & (count > 0), total / count).otherwise(depth)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rows - 1)), F.array().cast("array<double>"), fill)


def repair_depth(pixels: DataFrame, sensor: Sensor, step: int = REPAIR_STEP, threshold: float = REPAIR_DEPTH) -> DataFrame:
    """Dense pixels (frame_id, row, col, depth) with holes repaired."""
    return sparse(dense(pixels, sensor).select("frame_id", "col", repaired(F.col("depths"), sensor.rows, step, threshold).alias("depth")), "depth")


def _reflected(rows: int, r: Column) -> Column:
    """Row inside the image: mirrored at the first and last row, which are not repeated."""
    return F.lit(rows - 1) - F.abs(F.lit(rows - 1) - F.abs(r))


def filtered(values: Column, rows: int, kernel: list[float]) -> Column:
    """Column array correlated with a kernel, mirrored at the ends."""
    half = len(kernel) // 2
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: sum((F.lit(w) * F.get(values, _reflected(rows, r + k - half)) for k, w in enumerate(kernel) if w), F.lit(0.0)))


def repair_depth_uniform(pixels: DataFrame, sensor: Sensor, window: int = 5) -> DataFrame:
    """Dense pixels whose holes take the mean of the two returns ``window // 2`` rows up and down."""
    columns = dense(pixels, sensor)
    mean = filtered(F.col("depths"), sensor.rows, uniform_kernel(window))
    return sparse(columns.select("frame_id", "col", F.zip_with("depths", mean, lambda d, m: F.when(d > 0, d).otherwise(m)).alias("depth")), "depth")


def slopes(depths: Column, sensor: Sensor) -> Column:
    """Column array of the slope between each return and the one in the row before; 0 in the first row."""
    cos, sin = (F.lit([f(a) for a in sensor.row_angles]) for f in (math.cos, math.sin))

    def slope(r: Column) -> Column:
        dx, dy = (F.abs(F.get(depths, r) * F.get(t, r) - F.get(depths, r - 1) * F.get(t, r - 1)) for t in (cos, sin))
        return F.when(r == 0, F.lit(0.0)).otherwise(F.atan2(dy, dx))

    return F.transform(F.sequence(F.lit(0), F.lit(sensor.rows - 1)), slope)


def angle_image(pixels: DataFrame, sensor: Sensor) -> DataFrame:
    """Dense (frame_id, row, col, angle) in radians."""
    return sparse(dense(pixels, sensor).select("frame_id", "col", slopes(F.col("depths"), sensor).alias("angle")), "angle")


def smooth_slopes(pixels: DataFrame, sensor: Sensor, window: int) -> DataFrame:
    """Dense (frame_id, row, col, angle): slopes smoothed down each column, in one pass over column arrays."""
    columns = dense(pixels, sensor).select("frame_id", "col", slopes(F.col("depths"), sensor).alias("slope"))
    return sparse(columns.select("frame_id", "col", filtered(F.col("slope"), sensor.rows, smoothing_kernel(window)).alias("angle")), "angle")


def smooth_columns(angles: DataFrame, sensor: Sensor, window: int, column: str = "angle") -> DataFrame:
    """Dense (frame_id, row, col, <column>) smoothed down each column."""
    columns = dense(angles.withColumnRenamed(column, "depth"), sensor)
    return sparse(columns.select("frame_id", "col", filtered(F.col("depths"), sensor.rows, smoothing_kernel(window)).alias(column)), column)


def prepared(pixels: DataFrame, sensor: Sensor, window: int) -> DataFrame:
    """Dense (frame_id, row, col, depth, angle): repaired depths and smoothed slopes, in one pass over column arrays."""
    columns = dense(pixels, sensor).select("frame_id", "col", repaired(F.col("depths"), sensor.rows).alias("depth"))
    columns = columns.select("frame_id", "col", "depth", slopes(F.col("depth"), sensor).alias("slope"))
    return sparse(columns.select("frame_id", "col", "depth", filtered(F.col("slope"), sensor.rows, smoothing_kernel(window)).alias("angle")), "depth", "angle")


def zero_ground_threshold(pixels: DataFrame, threshold: float) -> DataFrame:
    """Pixels (frame_id, row, col, depth, angle): the depth stays only where the angle exceeds the threshold."""
    return pixels.withColumn("depth", F.when(F.col("angle") > threshold, F.col("depth")).otherwise(0.0))


def ground_seeds(pixels: DataFrame, sensor: Sensor, start: float = SEED_ANGLE) -> DataFrame:
    """(frame_id, col, row, seed) of every column of dense pixels with depth and angle: its lowest return, row 0 without one."""
    low = F.max(F.when((F.col("depth") >= HOLE) | (F.col("row") == 0), F.struct("row", "angle")))
    return pixels.groupBy("frame_id", "col").agg(low.alias("low")).select("frame_id", "col", F.col("low.row").alias("row"), (F.col("low.angle") <= start).alias("seed"))


def dilation_offsets(window: int, compat: bool = False) -> list[int]:
    """Rows around a pixel that turn it into ground.

    The kernel has max(window - 2, 3) rows. ``compat`` gives the offsets of the two non-zero bytes that a
    float kernel read as bytes has (none for three rows).
    """
    size = max(window - 2, 3)
    if compat:
        return [k - size // 2 for k in (2, 3) if size > 3]
    return list(range(-(size // 2), size // 2 + 1))


def flood(depth: np.ndarray, angle: np.ndarray, sensor: Sensor, threshold: float, start: float = SEED_ANGLE) -> np.ndarray:
    """Mask of what the flood from the lowest returns reaches over slopes that differ by less than the threshold."""
    rows, cols = depth.shape
    a, b = grid_edges(depth, angle, sensor, diff("simple"), threshold, 1, 1)
    seen = (depth >= HOLE).ravel()
    has = depth >= HOLE
    low = np.where(has.any(axis=0), rows - 1 - np.argmax(has[::-1], axis=0), 0)
    places = low * cols + np.arange(cols)
    places = places[angle.ravel()[places] <= start]
    both = seen[a] & seen[b]
    root = roots(depth.size, a[both], b[both])
    mask = np.zeros(depth.size, bool)
    mask[np.flatnonzero(seen)] = np.isin(root[seen], root[places[seen[places]]])
    for x, y in ((a, b), (b, a)):
        mask[y[mask[x] & seen[x] & ~seen[y]]] = True  # a hole is reached but leads nowhere
    mask[places] = True
    return mask.reshape(depth.shape)


def ground_mask(pixels: DataFrame, sensor: Sensor, threshold: float, window: int = 5, compat: bool = False) -> DataFrame:
    """Dense (frame_id, row, col, depth, flooded, ground) of dense pixels with depth and angle; ground is the dilated flood."""
    offsets = dilation_offsets(window, compat)

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        r, c = table["row"].to_numpy(), table["col"].to_numpy()
        depth, angle = np.zeros((sensor.rows, sensor.cols)), np.zeros((sensor.rows, sensor.cols))
        depth[r, c], angle[r, c] = table["depth"].to_numpy(), table["angle"].to_numpy()
        mask = flood(depth, angle, sensor, threshold)
        ground = np.zeros_like(mask)
        for k in offsets:
            to = slice(max(0, -k), sensor.rows - max(0, k))
            ground[to] |= mask[max(0, k) : sensor.rows + min(0, k)]
        return pa.table({"frame_id": table["frame_id"], "row": table["row"], "col": table["col"], "depth": table["depth"], "flooded": mask[r, c], "ground": ground[r, c]})

    rows = pixels.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("depth").cast("double").alias("depth"), F.col("angle").cast("double").alias("angle"))
    return rows.groupBy("frame_id").applyInArrow(kernel, "frame_id long, row int, col int, depth double, flooded boolean, ground boolean")


def remove_ground(pixels: DataFrame, sensor: Sensor, angle_deg: float = 5.0, window: int = 5, compat: bool = False) -> DataFrame:
    """Dense (frame_id, row, col, depth): repaired depths, 0 on the ground."""
    mask = ground_mask(prepared(pixels, sensor, window), sensor, math.radians(angle_deg), window, compat)
    return mask.select("frame_id", "row", "col", F.when(F.col("ground"), 0.0).otherwise(F.col("depth")).alias("depth"))


def line_angle(pixels: DataFrame, sensor: Sensor, row_a: int, row_b: int) -> DataFrame:
    """(frame_id, col, angle) of the line between the returns of two rows; 0 if either is a hole."""
    pick = lambda r: F.coalesce(F.max(F.when(F.col("row") == r, F.col("depth").cast("double"))), F.lit(0.0))
    both = pixels.where(F.col("row").isin(row_a, row_b)).groupBy("frame_id", "col").agg(pick(row_a).alias("a"), pick(row_b).alias("b"))
    va, vb = sensor.angle_from_row(row_a), sensor.angle_from_row(row_b)
    dx, dy = (F.abs(F.col("a") * f(va) - F.col("b") * f(vb)) for f in (math.cos, math.sin))
    seen = (F.col("a") >= HOLE) & (F.col("b") >= HOLE)
    return both.select("frame_id", "col", F.when(seen, F.atan2(dy, dx)).otherwise(0.0).alias("angle"))
