import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangescan.functions import angles, colors, pose


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_local_frames(spark):
    a, b = pose.planar(2.0, 1.0, math.pi / 2), pose.planar(1.0, 0.0, 0.0)
    for p, q, want in ((a, b, (1, 1, math.pi / 2)), (b, a, (-1, 1, -math.pi / 2))):
        got = pose.in_local_frame(p, q)
        xyz = value(spark, pose.position(got))
        assert (xyz.x, xyz.y, value(spark, pose.theta(got))) == pytest.approx(want, abs=1e-9)


def test_full_turn_is_none(spark):
    assert value(spark, pose.theta(pose.planar(0.0, 0.0, 2 * math.pi))) == pytest.approx(0, abs=1e-6)


def test_vector_round_trip(spark):
    v = (1.0, 2.0, 3.0, math.pi / 3, math.pi / 4, math.pi / 2)
    assert tuple(value(spark, pose.to_vector(pose.from_vector(*map(F.lit, v))))) == pytest.approx(v)


def test_inverse_against_numpy(spark):
    p = pose.from_vector(*map(F.lit, (1.0, -2.0, 0.5, 0.3, -0.4, 1.1)))
    m, inv = (np.array(value(spark, x)).reshape(4, 4) for x in (p, pose.inverse(p)))
    assert inv == pytest.approx(np.linalg.inv(m))
    assert np.array(value(spark, pose.multiply(p, pose.inverse(p)))).reshape(4, 4) == pytest.approx(np.eye(4))


def test_setters_overwrite(spark):
    p = pose.with_roll(pose.with_pitch(pose.with_yaw(pose.with_position(pose.identity(), 1, 2, 3), 0.3), 0.2), 0.1)
    m = np.array(value(spark, p)).reshape(4, 4)
    assert m[0, 0] == pytest.approx(math.cos(0.2)) and m[1, 1] == pytest.approx(math.cos(0.1)) and m[1, 0] == pytest.approx(math.sin(0.3)) and m[:3, 3] == pytest.approx([1, 2, 3])


def test_negation_keeps_no_rotation(spark):
    m = np.array(value(spark, pose.negated(pose.planar(1.0, 2.0, 0.7)))).reshape(4, 4)
    assert m == pytest.approx(np.array([[1, 0, 0, -1], [0, 1, 0, -2], [0, 0, 1, 0], [0, 0, 0, 1]]))


def test_moved_point(spark):
    assert tuple(value(spark, pose.transform(pose.planar(1.0, 0.0, 0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)))) == (2, 1, 1)


def test_likelihood(spark):
    assert value(spark, pose.checked_likelihood(F.lit(0.5))) == 0.5
    with pytest.raises(Exception, match="likelihood"):
        value(spark, pose.checked_likelihood(F.lit(1.5)))


def test_normalize(spark):
    got = [value(spark, angles.normalize(F.lit(x), 0.0, 360.0)) for x in (0.0, 360.0, 361.0, -1.0, 725.0, -720.0)]
    assert got == pytest.approx([0, 360, 1, 359, 5, 0])


def test_comparisons_have_slack(spark):
    assert not value(spark, angles.less(F.lit(1.0), F.lit(1.0 + 1e-8))) and value(spark, angles.greater(F.lit(1.1), F.lit(1.0)))
    assert value(spark, angles.floor_degrees(F.radians(F.lit(10.7)))) == pytest.approx(math.radians(10))


def test_colors(spark):
    assert len(colors.PALETTE) == 200
    assert tuple(value(spark, colors.label_color(F.lit(201)))) == colors.PALETTE[1] and tuple(value(spark, colors.label_color(F.lit(0)))) == colors.PALETTE[0]
    assert tuple(value(spark, colors.diff_color(F.lit(1.0), F.lit(0.0), F.lit(89.5), 90.0))) == (255, 2, 0)
    assert tuple(value(spark, colors.diff_color(F.lit(0.0), F.lit(9.0), F.lit(9.0), 90.0))) == (0, 0, 0)
