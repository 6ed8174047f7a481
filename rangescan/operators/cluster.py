"""Clusters of points: by labels of their pixels, or by distance in space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangescan.operators.components import min_labels


@dataclass(frozen=True)
class ClusterParams:
    tolerance: float = 0.2
    min_size: int = 100
    max_size: int = 25_000
    skip: int = 10

    def limits(self, compat: bool = False) -> tuple[int, int]:
        """Size limits; ``compat`` keeps their low 16 bits only."""
        return (self.min_size % 65536, self.max_size % 65536) if compat else (self.min_size, self.max_size)


def size_filter(clusters: DataFrame, min_size: int = 100, max_size: int = 25_000, compat: bool = False) -> DataFrame:
    """Rows of clusters with at least ``min_size`` and at most ``max_size`` points.

    Sizes are counted over the rows of each (frame_id, label), so what gives the clusters runs once.
    """
    low, high = ClusterParams(min_size=min_size, max_size=max_size).limits(compat)
    counted = clusters.withColumn("_size", F.count("*").over(Window.partitionBy("frame_id", "label")))
    return counted.where(F.col("_size").between(low, high)).drop("_size")


def cluster_points(points: DataFrame, point_pixel: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with the label of their pixel; points of unlabelled pixels go."""
    placed = points.join(point_pixel, ["frame_id", "point_idx"]) if not {"row", "col"} <= set(points.columns) else points
    return placed.join(labels.where(F.col("label") >= 1), ["frame_id", "row", "col"])


def cluster(points: DataFrame, point_pixel: DataFrame, labels: DataFrame, min_size: int = 100, max_size: int = 25_000, compat: bool = False) -> DataFrame:
    """Labelled points of clusters within the size limits."""
    return size_filter(cluster_points(points, point_pixel, labels), min_size, max_size, compat)


def euclidean_cluster(points: DataFrame, tolerance: float = 0.2, min_size: int = 100, max_size: int = 25_000, skip: int = 1) -> DataFrame:
    """Points (frame_id, point_idx, x, y, z) with the smallest point_idx of their cluster as ``label``.

    Points within the tolerance are in one cluster. Points are put into cubes as wide as the tolerance and
    joined with those of the same and adjacent cubes by cube; of frames only every ``skip``-th is clustered.
    """
    chosen = points.where(F.pmod(F.col("frame_id"), F.lit(skip)) == 0)
    cell = [F.floor(F.col(c) / tolerance).cast("long").alias(f"c{c}") for c in "xyz"]
    a = chosen.select("frame_id", F.col("point_idx").alias("src"), *(F.col(c).cast("double").alias(f"a{c}") for c in "xyz"), *cell)
    shifts = F.array(*[F.struct(*(F.lit(v).cast("long").alias(f"d{c}") for c, v in zip("xyz", d, strict=True))) for d in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]])
    b = chosen.select("frame_id", F.col("point_idx").alias("dst"), *(F.col(c).cast("double").alias(f"b{c}") for c in "xyz"), *cell, F.explode(shifts).alias("d"))
    b = b.select("frame_id", "dst", *(f"b{c}" for c in "xyz"), *((F.col(f"c{c}") + F.col(f"d.d{c}")).alias(f"c{c}") for c in "xyz"))
    near = sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)) <= tolerance * tolerance
    edges = a.join(b, ["frame_id", "cx", "cy", "cz"]).where((F.col("src") < F.col("dst")) & near).select("frame_id", "src", "dst")
    root = min_labels(chosen.select("frame_id", F.col("point_idx").alias("id")), edges)
    named = chosen.join(root.select("frame_id", F.col("id").alias("point_idx"), F.col("root").alias("label")), ["frame_id", "point_idx"])
    return size_filter(named, min_size, max_size)


def cluster_map(clusters: DataFrame) -> DataFrame:
    """(frame_id, clusters): map from label to its points, for sinks that take a frame at a time."""
    one = clusters.groupBy("frame_id", "label").agg(F.sort_array(F.collect_list(F.struct("point_idx", "x", "y", "z", "ring"))).alias("points"))
    return one.groupBy("frame_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "points")))).alias("clusters"))


def renumbered(clusters: DataFrame) -> DataFrame:
    """Labels 1, 2, ... within each frame, in the order of the old ones."""
    return clusters.withColumn("label", F.dense_rank().over(Window.partitionBy("frame_id").orderBy("label")))
