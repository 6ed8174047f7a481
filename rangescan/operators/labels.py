"""Connected components on the pixel grid.

Pixels are vertices, neighbours whose difference passes the test are joined; rows end at the border,
columns wrap around. A label is the rank of its component by the smallest pixel place. A pixel without
a depth joins nothing, but takes the smallest label of a neighbour that reaches it.

A frame is bounded by the sensor's image, so the default is one kernel call a frame behind one exchange
by frame. ``native`` keeps everything in the JVM for images that do not fit a worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangescan.functions.diff import ArrayMath, Diff, diff
from rangescan.operators.components import min_labels, written
from rangescan.operators.project import HOLE, dense, sparse
from rangescan.plans.sensor import Sensor


def neighbourhood(step_row: int = 1, step_col: int = 1) -> list[tuple[int, int]]:
    """Offsets of the neighbours, farthest first, rows before columns."""
    return [(s * k, 0) for k in range(step_row, 0, -1) for s in (-1, 1)] + [(0, s * k) for k in range(step_col, 0, -1) for s in (-1, 1)]


def _alpha(sensor: Sensor, dr: int, dc: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Beam angle of the move by (dr, dc), dr or dc positive, from each pixel; several steps take that of the first."""
    if dr:
        return np.asarray(sensor.row_alphas)[rows]
    to = (cols + dc) % sensor.cols
    low, high = np.minimum(cols, to), np.maximum(cols, to)
    wraps = (low == 0) & (high == sensor.cols - 1)
    return np.where(wraps, sensor.col_alphas[-1], np.asarray(sensor.col_alphas)[low])


def grid_edges(depth: np.ndarray, value: np.ndarray, sensor: Sensor, kind: Diff, threshold: float, step_row: int, step_col: int) -> tuple[np.ndarray, np.ndarray]:
    """Joined pairs of places of one image; ``value`` is what differences are taken of."""
    rows, cols = depth.shape
    row, col = np.indices(depth.shape)
    a_all, b_all = [], []
    for dr, dc in {(abs(r), abs(c)) for r, c in neighbourhood(step_row, step_col)}:
        ok = row + dr < rows
        r, c = row[ok], col[ok]
        r2, c2 = r + dr, (c + dc) % cols
        passed = kind.satisfied(kind.value(value[r, c], value[r2, c2], _alpha(sensor, dr, dc, r, c), ArrayMath), threshold) & ((r != r2) | (c != c2))
        a_all.append((r * cols + c)[passed])
        b_all.append((r2 * cols + c2)[passed])
    return np.concatenate(a_all), np.concatenate(b_all)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n vertices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


def label_grid(depth: np.ndarray, value: np.ndarray, sensor: Sensor, kind: Diff, threshold: float, step_row: int = 1, step_col: int = 1) -> np.ndarray:
    """Labels of one dense image."""
    a, b = grid_edges(depth, value, sensor, kind, threshold, step_row, step_col)
    seen = depth.ravel() >= HOLE
    both = seen[a] & seen[b]
    root = roots(depth.size, a[both], b[both])
    labels = np.zeros(depth.size, np.int64)
    labels[seen] = np.unique(root[seen], return_inverse=True)[1] + 1
    for x, y in ((a, b), (b, a)):
        leaf = seen[x] & ~seen[y]
        order = np.argsort(-labels[x[leaf]], kind="stable")  # the smallest label is written last
        new = np.zeros(depth.size, np.int64)
        new[y[leaf][order]] = labels[x[leaf][order]]
        take = (new > 0) & ~seen & ((labels == 0) | (new < labels))
        labels[take] = new[take]
    return labels.reshape(depth.shape)


def grid_of(table: pa.Table, sensor: Sensor, column: str) -> np.ndarray:
    image = np.zeros((sensor.rows, sensor.cols))
    image[table["row"].to_numpy(), table["col"].to_numpy()] = table[column].to_numpy()
    return image


def label_image(pixels: DataFrame, sensor: Sensor, kind: str = "angle", threshold: float = 0.17, step_row: int = 1, step_col: int = 1, native: bool = False) -> DataFrame:
    """(frame_id, row, col, label) of every pixel that has one; pixels (frame_id, row, col, depth) may be sparse."""
    helper = diff(kind)
    rows = pixels.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("depth").cast("double").alias("depth"))
    if native:
        if not helper.above:  # a hole can be near a small depth: the image needs its holes
            rows = sparse(dense(rows, sensor), "depths").withColumnRenamed("depths", "depth")
        return _native(rows, sensor, helper, threshold, step_row, step_col)

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        depth = grid_of(table, sensor, "depth")
        labels = label_grid(depth, depth, sensor, helper, threshold, step_row, step_col)
        r, c = np.nonzero(labels)
        return pa.table({"frame_id": pa.array([key[0].as_py()] * len(r), pa.int64()), "row": r.astype(np.int32), "col": c.astype(np.int32), "label": labels[r, c].astype(np.int32)})

    return rows.groupBy("frame_id").applyInArrow(kernel, "frame_id long, row int, col int, label int")


def edge_table(pixels: DataFrame, sensor: Sensor, kind: str, step_row: int = 1, step_col: int = 1) -> DataFrame:
    """Differences of neighbours: (frame_id, src, dst, axis, depth_a, depth_b, diff), each pair once, src before the move down or right.

    src and dst are pixel places, row * cols + col. Pixels are joined on shifted keys, no theta join.
    """
    spark, helper = pixels.sparkSession, diff(kind)
    moves = sorted({(abs(r), abs(c)) for r, c in neighbourhood(step_row, step_col)})
    a = pixels.select("frame_id", F.col("row").alias("r"), F.col("col").alias("c"), F.col("depth").cast("double").alias("depth_a"), F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in moves])).alias("m"))
    a = a.select("frame_id", "r", "c", "depth_a", F.col("m.dr").alias("dr"), (F.col("r") + F.col("m.dr")).alias("row"), F.pmod(F.col("c") + F.col("m.dc"), F.lit(sensor.cols)).alias("col"))
    b = pixels.select("frame_id", "row", "col", F.col("depth").cast("double").alias("depth_b"))
    low, high = F.least("c", "col"), F.greatest("c", "col")
    joined = a.join(b, ["frame_id", "row", "col"]).where((F.col("r") != F.col("row")) | (F.col("c") != F.col("col")))
    key = F.when(F.col("dr") > 0, F.lit(-1)).when((low == 0) & (high == sensor.cols - 1), sensor.cols - 1).otherwise(low)
    rows = F.broadcast(sensor.row_table(spark).select(F.col("row").alias("r"), "row_alpha"))  # one line a row of the sensor
    cols = F.broadcast(sensor.col_table(spark).select(F.col("col").alias("key"), "col_alpha"))
    full = joined.withColumn("key", key).join(rows, "r").join(cols, "key", "left")
    value = helper.value(F.col("depth_a"), F.col("depth_b"), F.coalesce("col_alpha", "row_alpha"))
    place = lambda r, c: F.col(r).cast("long") * sensor.cols + F.col(c)
    return full.select("frame_id", place("r", "c").alias("src"), place("row", "col").alias("dst"), F.when(F.col("dr") > 0, "row").otherwise("col").alias("axis"), "depth_a", "depth_b", value.alias("diff"))


def _native(pixels: DataFrame, sensor: Sensor, helper: Diff, threshold: float, step_row: int, step_col: int) -> DataFrame:
    pixels = written(pixels, "grid-pixels")
    edges = edge_table(pixels, sensor, helper.name, step_row, step_col)
    joined = written(edges.where(helper.satisfied(F.col("diff"), threshold)).select("frame_id", "src", "dst", "depth_a", "depth_b"), "grid-joined")
    both = joined.where((F.col("depth_a") >= HOLE) & (F.col("depth_b") >= HOLE)).select("frame_id", "src", "dst")
    place = F.col("row").cast("long") * sensor.cols + F.col("col")
    vertices = pixels.where(F.col("depth") >= HOLE).select("frame_id", place.alias("id"))
    root = min_labels(vertices, both)
    named = root.withColumn("label", F.dense_rank().over(Window.partitionBy("frame_id").orderBy("root"))).select("frame_id", "id", "label")
    one = joined.where((F.col("depth_a") >= HOLE) != (F.col("depth_b") >= HOLE))
    inner = F.when(F.col("depth_a") >= HOLE, F.col("src")).otherwise(F.col("dst"))
    outer = F.when(F.col("depth_a") >= HOLE, F.col("dst")).otherwise(F.col("src"))
    leaves = one.select("frame_id", inner.alias("id"), outer.alias("leaf")).join(named, ["frame_id", "id"]).groupBy("frame_id", F.col("leaf").alias("id")).agg(F.min("label").alias("label"))
    return named.union(leaves).select("frame_id", F.expr(f"cast(id div {sensor.cols} as int)").alias("row"), F.expr(f"cast(id % {sensor.cols} as int)").alias("col"), F.col("label").cast("int").alias("label"))
