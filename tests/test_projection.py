import math

import pytest
from pyspark.sql import functions as F

from rangescan.operators import project
from rangescan.plans.sensor import Sensor, Span, from_degrees

POINTS = "frame_id long, point_idx long, x double, y double, z double, ring int"


def spans(v, h):
    make = lambda a: Span.by_count(from_degrees(a[0]), from_degrees(a[1]), a[2])
    return Sensor.from_spans([make(v)], [make(h)])


def test_points_on_a_circle(spark):
    sensor = spans((-0.5, 0.5, 1), (-180, 180, 12))
    rows = [(0, k, 10 * math.cos(math.radians(-180 + 30 * k + 0.01)), 10 * math.sin(math.radians(-180 + 30 * k + 0.01)), 0.0, 0) for k in range(12)]
    got = project.binned(spark.createDataFrame(rows, POINTS), sensor).orderBy("point_idx").collect()
    assert [(r.row, r.col) for r in got] == [(0, k) for k in range(12)]


def test_the_farthest_return_counts_and_near_points_go(spark):
    sensor = spans((-10, 10, 4), (-180, 180, 8))
    rows = [(0, 0, 1.0, 0.0, 0.0, 0), (0, 1, 5.0, 0.0, 0.0, 0), (0, 2, 0.001, 0.0, 0.0, 0)]
    pixels, placed = project.project(spark.createDataFrame(rows, POINTS), sensor)
    assert [r.depth for r in pixels.collect()] == [5.0] and placed.count() == 2


def test_ring_projection_uses_the_plane(spark):
    sensor = spans((-10, 10, 4), (-180, 180, 8))
    rows = [(0, 0, 3.0, 4.0, 7.0, 2), (0, 1, 3.0, 4.0, 0.0, 9)]
    pixels, _ = project.project(spark.createDataFrame(rows, POINTS), sensor, "ring")
    assert [(r.row, r.depth) for r in pixels.collect()] == [(2, 5.0)]


def test_round_trip_over_a_sphere(spark):
    sensor = Sensor.full_sphere(10)
    points = spark.range(0, 36 * 18).select(F.lit(0).cast("long").alias("frame_id"), (F.col("id") % 18).cast("int").alias("row"), F.expr("cast(id div 18 as int)").alias("col"), F.lit(100.0).alias("depth"))
    # straight up has no azimuth, and the seam at 180 degrees belongs to the last column
    cloud = project.unproject(points, sensor).where("row > 0 and col > 0")
    pixels, placed = project.project(cloud.drop("row", "col", "depth"), sensor)
    assert placed.count() == 35 * 17
    both = pixels.alias("a").join(points.alias("b"), ["frame_id", "row", "col"])
    assert both.where("col > 0").count() == 35 * 17 and both.where("abs(a.depth - b.depth) > 0.001").count() == 0


def test_second_projection_is_refused(spark):
    with pytest.raises(ValueError, match="already initialized"):
        project.binned(spark.createDataFrame([], POINTS + ", row int"), Sensor.vlp_16())
    with pytest.raises(ValueError, match="no points"):
        project.checked_points(spark.createDataFrame([], POINTS))


def test_image_outside_the_sensor(spark):
    bad = spark.createDataFrame([(0, 40, 0, 1.0)], "frame_id long, row int, col int, depth double")
    with pytest.raises(Exception, match="image size"):
        project.checked_image(bad, Sensor.vlp_16()).collect()


def test_corrections(spark):
    sensor = Sensor((0.0, 0.1), (0.0, 1.0), 2.0, (0.5, 0.25))
    rows = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 0, 2.0), (0, 1, 1, 0.0)], "frame_id long, row int, col int, depth double")
    assert sorted(r.depth for r in project.correct(rows, sensor).collect()) == [0.0, 1.5, 1.75]


def test_distances(spark):
    r = spark.range(1).select(project.distance_2d(F.lit(3.0), F.lit(4.0)).alias("a"), project.distance_3d(F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("b")).first()
    assert (r.a, r.b) == (5.0, 3.0)
