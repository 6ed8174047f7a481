import numpy as np
import pytest
from pyspark.sql import functions as F

from rangescan.functions import pose
from rangescan.operators import cluster, objects

SCHEMA = "frame_id long, label int, point_idx long, x double, y double, z double, ring int"


def boxes_of(spark, corners):
    rows = [(0, k + 1, 2 * k + j, *map(float, p), 0) for k, pair in enumerate(corners) for j, p in enumerate(pair)]
    return objects.bboxes(spark.createDataFrame(rows, SCHEMA))


def test_boxes_and_flat_ones(spark):
    a, flat = boxes_of(spark, [((0, 0, 0), (2, 4, 6)), ((1, 1, 1), (1, 5, 5))]).orderBy("label").collect()
    assert (a.center_x, a.center_y, a.center_z, a.volume) == (1, 2, 3, 48)
    assert (flat.volume, flat.center_y, flat.scale_z) == (-1, 0, 0)


def test_overlaps_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    low = rng.uniform(-20, 20, (60, 3))
    high = low + rng.uniform(0.5, 9, (60, 3))
    got = {(r.label_a, r.label_b): r.volume for r in objects.bbox_intersections(boxes_of(spark, list(zip(low, high, strict=True)))).collect()}
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            side = np.minimum(high[i], high[j]) - np.maximum(low[i], low[j])
            if (side > 0).all():
                want[i + 1, j + 1] = side.prod()
    assert got == pytest.approx(want)


def test_moved_box_is_put_in_order(spark):
    b = objects.move_box(boxes_of(spark, [((1, 1, 1), (2, 3, 4))]), pose.planar(0.0, 0.0, np.pi)).first()
    assert (b.min_x, b.max_x, b.min_y, b.max_y) == pytest.approx((-2, -1, -3, -1)) and b.volume == pytest.approx(6)


def test_object_box_and_class(spark):
    rows = [(0, 1, k, x, 0.0, z, 0) for k, (x, z) in enumerate([(0.0, 0.0), (1.0, 1.0), (8.0, 2.0)])] + [(0, 2, 9, 1.0, 1.0, 1.0, 0)]
    got = {r.label: r for r in objects.box_classes(objects.object_boxes(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got[1].center_x, got[1].extent_x, got[1].shown, got[1].large, got[1].marked) == (3.0, 8.0, True, True, False)
    assert (got[2].extent_x, got[2].shown) == (0.0, False)


def test_hull_drops_inner_and_flat(spark):
    pts = [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]
    rows = [(0, 1, k, float(x), float(y), k * 0.1, 0) for k, (x, y) in enumerate(pts)] + [(0, 2, 9 + k, float(k), float(k), 0.0, 0) for k in range(3)]
    (h,) = objects.object_hulls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(p.x, p.y) for p in h.hull} == {(0, 0), (2, 0), (2, 2), (0, 2)} and h.height == pytest.approx(0.5)


def test_size_limits_are_inclusive_and_may_wrap(spark):
    rows = [(0, n, 100 * n + k, 0.0, 0.0, 0.0, 0) for n in (1, 2, 3) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.label for r in cluster.size_filter(df, 2, 3).collect()} == {2, 3}
    assert cluster.ClusterParams(max_size=100_000).limits(compat=True) == (100, 34464)
    assert {r.label for r in cluster.size_filter(df, 2, 65536 + 2, compat=True).collect()} == {2}


def test_euclidean_clusters_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-3, 3, (150, 3))
    df = spark.createDataFrame([(f, 1000 * f + k, *map(float, p)) for f in (0, 1) for k, p in enumerate(xyz)], "frame_id long, point_idx long, x double, y double, z double")
    got = {r.point_idx: r.label for r in cluster.euclidean_cluster(df, 0.8, 1, 1000, skip=2).collect()}
    near = (np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= 0.8)
    root = np.arange(150)
    for _ in range(150):
        root = np.array([root[near[k]].min() for k in range(150)])
    assert got == dict(enumerate(root.tolist()))


def test_cluster_map(spark):
    rows = [(0, 1, 0, 0.0, 0.0, 0.0, 5), (0, 2, 1, 1.0, 0.0, 0.0, 6), (0, 2, 2, 2.0, 0.0, 0.0, 7)]
    m = cluster.cluster_map(spark.createDataFrame(rows, SCHEMA)).first().clusters
    assert sorted(m) == [1, 2] and [p.ring for p in m[2]] == [6, 7]


def test_transform_keeps_rings(spark):
    points = spark.createDataFrame([(0, 1, 0, 1.0, 1.0, 1.0, 4)], SCHEMA)
    poses = spark.createDataFrame([(0,)], "frame_id long").select("frame_id", pose.planar(1.0, 0.0, 0.0).alias("pose"))
    r = objects.transform_points(points, poses).first()
    assert (r.x, r.y, r.z, r.ring) == (2, 1, 1, 4)


def test_residuals(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 3.0)], "frame_id long, row int, col int, depth double")
    assert {(r.row, r.residual) for r in objects.calibration_residual(df, 2).collect()} == {(1, -1.0), (0, 1.0)} and F is not None
