import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangescan.operators import ground
from rangescan.plans.sensor import Sensor, Span, from_degrees
from tests.test_labels import frame, square


def grid(df, column, shape):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x.row, x.col] = x[column]
    return out


def test_kernels():
    assert ground.smoothing_kernel(5) == pytest.approx([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35])
    assert ground.smoothing_kernel(7) == pytest.approx([x / 21 for x in (-2, 3, 6, 7, 6, 3, -2)])
    assert ground.smoothing_kernel(9)[::4] == pytest.approx([-21 / 231, 59 / 231, -21 / 231])
    assert ground.smoothing_kernel(11)[::5] == pytest.approx([-36 / 429, 89 / 429, -36 / 429])
    for bad, why in ((2, "only odd window size allowed"), (131, "bad window size")):
        with pytest.raises(ValueError, match=why):
            ground.smoothing_kernel(bad)


def test_slope_of_nothing_and_of_a_wall(spark):
    sensor = square(5)
    flat = grid(ground.angle_image(frame(spark, np.zeros((5, 5))), sensor), "angle", (5, 5))
    assert (flat == 0).all()
    wall = np.array([[1 / math.cos(a)] * 5 for a in sensor.row_angles])
    got = grid(ground.angle_image(frame(spark, wall), sensor), "angle", (5, 5))
    assert (got[0] == 0).all() and got[1:] == pytest.approx(np.full((4, 5), math.pi / 2), abs=1e-4)


def repaired(image, step=5, threshold=1.0):
    out = image.copy()
    for c in range(out.shape[1]):
        for r in range(out.shape[0]):
            if out[r, c] < 0.001:
                found = [out[r - i, c] + out[r + j, c] for i in range(1, step) for j in range(1, step) if r - i >= 0 and r + j < len(out) and out[r - i, c] > 0.001 and out[r + j, c] > 0.001 and abs(out[r - i, c] - out[r + j, c]) < threshold]
                if found:
                    out[r, c] = sum(found) / (2 * len(found))
    return out


def test_holes_are_repaired_from_above(spark):
    rng = np.random.default_rng(1)
    image = rng.choice([0.0, 0.0, 2.0, 2.5, 2.9, 9.0], size=(12, 30))
    sensor = Sensor(tuple(np.linspace(0, 0.2, 12).tolist()), tuple(np.linspace(0, 6, 30).tolist()), 2 * math.pi)
    assert grid(ground.repair_depth(frame(spark, image).where("depth > 0"), sensor), "depth", image.shape) == pytest.approx(repaired(image))


def test_smoothing_mirrors_at_the_ends(spark):
    image = np.arange(35.0).reshape(7, 5) ** 1.5
    sensor = Sensor(tuple(np.linspace(0, 0.2, 7).tolist()), tuple(np.linspace(0, 6, 5).tolist()), 2 * math.pi)
    got = grid(ground.smooth_columns(frame(spark, image).withColumnRenamed("depth", "angle"), sensor, 5), "angle", image.shape)
    wide = np.pad(image, ((2, 2), (0, 0)), mode="reflect")
    assert got == pytest.approx(sum(w * wide[k : k + 7] for k, w in enumerate(ground.smoothing_kernel(5))))


def test_ground_goes_and_objects_stay(spark):
    rows, cols = 16, 24
    sensor = Sensor(tuple(math.radians(-2 - 1.5 * r) for r in range(rows)), tuple(math.radians(15 * c) for c in range(cols)), 2 * math.pi)
    plane = np.array([[1.7 / math.sin(-a)] * cols for a in sensor.row_angles])
    image = plane.copy()
    image[:10, 5:8] = [[4.0 / math.cos(a)] * 3 for a in sensor.row_angles[:10]]  # a wall in front of the plane
    got = grid(ground.remove_ground(frame(spark, image), sensor, 9.0, 5), "depth", image.shape)
    assert (got[:8, 5:8] > 0).all() and (got[11:] == 0).all()


def test_dilation_offsets():
    assert ground.dilation_offsets(5) == [-1, 0, 1] and ground.dilation_offsets(7) == [-2, -1, 0, 1, 2]
    assert ground.dilation_offsets(7, compat=True) == [0, 1] and ground.dilation_offsets(9, compat=True) == [-1, 0] and ground.dilation_offsets(5, compat=True) == []


def test_line_angle_of_a_hole_is_zero(spark):
    sensor = square(5)
    got = ground.line_angle(frame(spark, np.ones((5, 5))).where("not (row = 1 and col = 2)"), sensor, 1, 3).orderBy("col").collect()
    assert got[2].angle == 0 and got[0].angle > 0


def test_threshold_variant(spark):
    rows = spark.createDataFrame([(0, 0, 0, 3.0, 0.5), (0, 1, 0, 3.0, 0.1)], "frame_id long, row int, col int, depth double, angle double")
    assert [r.depth for r in ground.zero_ground_threshold(rows, 0.2).orderBy("row").collect()] == [3.0, 0.0]


def test_seed_of_an_empty_column(spark):
    rows = spark.createDataFrame([(0, r, 0, 0.0, 0.0) for r in range(3)], "frame_id long, row int, col int, depth double, angle double")
    got = ground.ground_seeds(rows, square(3)).first()
    assert (got.row, got.seed) == (0, True)


def test_column_arrays_are_one_stage(spark):
    plan = ground.prepared(frame(spark, np.ones((5, 5))), square(5), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0 and F is not None
