"""Boxes and outlines of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least height of an outline or box that is shown, in metres.
LEAST_HEIGHT = 0.3


def _box(frame: DataFrame) -> DataFrame:
    """Add centre, scale and volume to minima and maxima; an empty extent gives zeros and volume -1."""
    flat = F.greatest(*(F.col(f"min_{c}") - F.col(f"max_{c}") for c in "xyz")) >= 0
    scale = {c: F.when(flat, 0.0).otherwise(F.col(f"max_{c}") - F.col(f"min_{c}")) for c in "xyz"}
    center = {c: F.when(flat, 0.0).otherwise((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2) for c in "xyz"}
    volume = F.when(flat, -1.0).otherwise((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z")))
    return frame.withColumns({f"center_{c}": v for c, v in center.items()} | {f"scale_{c}": v for c, v in scale.items()} | {"volume": volume})


def bboxes(clusters: DataFrame) -> DataFrame:
    """(frame_id, label, n_points, min_*, max_*, center_*, scale_*, volume) of every cluster."""
    bounds = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return _box(clusters.groupBy("frame_id", "label").agg(F.count("*").alias("n_points"), *bounds))


def bbox_intersections(boxes: DataFrame, cell: float = 5.0) -> DataFrame:
    """(frame_id, label_a, label_b, min_*, max_*, ..., volume) of boxes that overlap, label_a < label_b.

    Boxes are put into square cells of the ground plane that they touch and joined by cell; a pair counts
    in the cell of the corner of its overlap only.
    """
    keys = ["frame_id", "label", *(f"{n}_{c}" for n in ("min", "max") for c in "xyz")]
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    placed = boxes.select(*keys).withColumn("gx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("gy", F.explode(F.sequence(at("min_y"), at("max_y"))))
    a, b = (placed.select("frame_id", "gx", "gy", *(F.col(k).alias(f"{s}_{k}") for k in keys[1:])) for s in "ab")
    both = a.join(b, ["frame_id", "gx", "gy"]).where("a_label < b_label")
    low = {c: F.greatest(f"a_min_{c}", f"b_min_{c}") for c in "xyz"}
    high = {c: F.least(f"a_max_{c}", f"b_max_{c}") for c in "xyz"}
    both = both.select("frame_id", "gx", "gy", F.col("a_label").alias("label_a"), F.col("b_label").alias("label_b"), *(v.alias(f"min_{c}") for c, v in low.items()), *(v.alias(f"max_{c}") for c, v in high.items()))
    mine = (F.col("gx") == at("min_x")) & (F.col("gy") == at("min_y"))
    return _box(both.where(mine)).where("volume > 0").drop("gx", "gy")


def move_box(boxes: DataFrame, pose: Column) -> DataFrame:
    """Boxes with both corners moved by a pose (array of 16) and put in order again."""
    from rangescan.functions.pose import transform

    low, high = (transform(pose, *(F.col(f"{n}_{c}") for c in "xyz")) for n in ("min", "max"))
    moved = boxes.withColumns({"_low": low, "_high": high})
    moved = moved.withColumns({f"min_{c}": F.least(f"_low.{c}", f"_high.{c}") for c in "xyz"} | {f"max_{c}": F.greatest(f"_low.{c}", f"_high.{c}") for c in "xyz"})
    return _box(moved.drop("_low", "_high"))


def object_boxes(clusters: DataFrame) -> DataFrame:
    """(frame_id, label, center_*, extent_*): centre is the mean of the points, extent 0 unless the points differ in x."""
    aggs = [F.avg(F.col(c).cast("double")).alias(f"center_{c}") for c in "xyz"] + [(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))).alias(f"span_{c}") for c in "xyz"]
    boxes = clusters.groupBy("frame_id", "label").agg(*aggs)
    return boxes.select("frame_id", "label", *(f"center_{c}" for c in "xyz"), *(F.when(F.col("span_x") > 0, F.col(f"span_{c}")).otherwise(0.0).alias(f"extent_{c}") for c in "xyz"))


def box_classes(boxes: DataFrame, prefix: str = "extent") -> DataFrame:
    """Boxes with ``shown``, ``large`` (grey) and ``marked``, by their sides.

    shown: at least 0.3 m high. large: more than 20 cubic metres or a side above 5 m. marked: below 30
    cubic metres and all sides below 6 m.
    """
    x, y, z = (F.col(f"{prefix}_{c}") for c in "xyz")
    volume, longest = x * y * z, F.greatest(x, y, z)
    return boxes.withColumns({"shown": z >= LEAST_HEIGHT, "large": (volume > 20) | (longest > 5), "marked": (volume < 30) & (longest < 6)})


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points in the plane, counter-clockwise from the lowest x; collinear points are left out."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])


def object_hulls(clusters: DataFrame, least_height: float = LEAST_HEIGHT) -> DataFrame:
    """(frame_id, label, min_z, height, hull) of clusters at least 0.3 m high; hull: array of struct(x, y). One call a frame."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("label")
        label, z, xy = table["label"].to_numpy(), table["z"].to_numpy(), np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()])
        starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        low, high = np.minimum.reduceat(z, starts), np.maximum.reduceat(z, starts)
        tall = np.flatnonzero(high - low >= least_height)
        ends = np.append(starts[1:], len(label))
        rings = [[{"x": x, "y": y} for x, y in hull(xy[starts[k] : ends[k]]).tolist()] for k in tall]
        cols = [pa.array([key[0].as_py()] * len(tall), pa.int64()), pa.array(label[starts[tall]], pa.int64()), pa.array(low[tall]), pa.array((high - low)[tall]), pa.array(rings, pa.list_(point))]
        return pa.table(cols, ["frame_id", "label", "min_z", "height", "hull"])

    rows = clusters.select(F.col("frame_id").cast("long"), F.col("label").cast("long"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return rows.groupBy("frame_id").applyInArrow(kernel, "frame_id long, label long, min_z double, height double, hull array<struct<x: double, y: double>>")


def calibration_residual(pixels: DataFrame, rows: int) -> DataFrame:
    """(frame_id, col, row, residual): depth less the mean of its column; rows are counted from the bottom."""
    mean = pixels.groupBy("frame_id", "col").agg(F.avg(F.col("depth").cast("double")).alias("mean"))
    return pixels.join(mean, ["frame_id", "col"]).select("frame_id", "col", (F.lit(rows - 1) - F.col("row")).alias("row"), (F.col("depth").cast("double") - F.col("mean")).alias("residual"))


def transform_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points moved by the pose of their frame (frame_id, pose); rings stay, pixels of a projection go."""
    from rangescan.functions.pose import transform

    moved = points.drop("row", "col").join(poses.select("frame_id", "pose"), "frame_id").withColumn("_p", transform(F.col("pose"), *(F.col(c).cast("double") for c in "xyz")))
    return moved.withColumns({c: F.col(f"_p.{c}") for c in "xyz"}).drop("_p", "pose")
