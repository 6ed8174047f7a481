"""Poses as array<double> of 16, row by row; built and combined inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entry(pose: Column, row: int, col: int) -> Column:
    return F.get(pose, F.lit(4 * row + col))


def _matrix(entries: list[list[Column]]) -> Column:
    return F.array(*[e.cast("double") for line in entries for e in line])


def _lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def identity() -> Column:
    return _matrix([[F.lit(float(r == c)) for c in range(4)] for r in range(4)])


def planar(x: float | Column, y: float | Column, theta: float | Column) -> Column:
    """Pose in the plane."""
    return with_theta(with_position(identity(), x=x, y=y), theta)


def with_entries(pose: Column, values: dict[tuple[int, int], Column]) -> Column:
    """The pose with some entries overwritten; the others stay, nothing is composed."""
    return _let(pose, lambda p: _matrix([[values.get((r, c), _entry(p, r, c)) for c in range(4)] for r in range(4)]))


def with_position(pose: Column, x: float | Column | None = None, y: float | Column | None = None, z: float | Column | None = None) -> Column:
    return with_entries(pose, {(k, 3): _lit(v) for k, v in enumerate((x, y, z)) if v is not None})


def with_theta(pose: Column, theta: float | Column) -> Column:
    c, s = F.cos(_lit(theta)), F.sin(_lit(theta))
    return with_entries(pose, {(0, 0): c, (0, 1): -s, (1, 0): s, (1, 1): c})


with_yaw = with_theta


def with_pitch(pose: Column, pitch: float | Column) -> Column:
    c, s = F.cos(_lit(pitch)), F.sin(_lit(pitch))
    return with_entries(pose, {(0, 0): c, (2, 2): c, (0, 2): -s, (2, 0): s})


def with_roll(pose: Column, roll: float | Column) -> Column:
    c, s = F.cos(_lit(roll)), F.sin(_lit(roll))
    return with_entries(pose, {(1, 1): c, (2, 2): c, (1, 2): -s, (2, 1): s})


def position(pose: Column) -> Column:
    return F.struct(*(_entry(pose, k, 3).alias(n) for k, n in enumerate("xyz")))


def theta(pose: Column) -> Column:
    """Heading in the plane: minus the arc cosine unless the sine entry is positive."""
    a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _entry(pose, 0, 0))))
    return F.when(_entry(pose, 1, 0) > 0, a).otherwise(-a)


def checked_likelihood(value: Column) -> Column:
    """The value, or an error outside 0..1."""
    return F.when(value.between(0, 1), value).otherwise(F.raise_error(F.lit("likelihood must lie in 0..1")).cast("double"))


def multiply(a: Column, b: Column) -> Column:
    entry = lambda p, q, r, c: sum((_entry(p, r, k) * _entry(q, k, c) for k in range(1, 4)), _entry(p, r, 0) * _entry(q, 0, c))
    return _let(a, lambda p: _let(b, lambda q: _matrix([[entry(p, q, r, c) for c in range(4)] for r in range(4)])))


def _inverse(pose: Column) -> Column:
    m = [[_entry(pose, r, c) for c in range(3)] for r in range(3)]
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    inv = [[minor(c, r) / det for c in range(3)] for r in range(3)]
    t = [_entry(pose, k, 3) for k in range(3)]
    return _matrix([*([*line, -(line[0] * t[0] + line[1] * t[1] + line[2] * t[2])] for line in inv), [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]])


def inverse(pose: Column) -> Column:
    """Inverse of an affine pose: cofactors of the 3x3 part, then the translation."""
    return _let(pose, _inverse)


def in_local_frame(pose: Column, other: Column) -> Column:
    """The pose as seen from another one."""
    return multiply(inverse(other), pose)


def negated(pose: Column) -> Column:
    """Position negated, rotation reset to identity."""
    return _let(pose, lambda p: with_position(identity(), *(-_entry(p, k, 3) for k in range(3))))


def from_vector(x: Column, y: Column, z: Column, roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rotation about x, then y, then z axis (intrinsic), with a translation."""
    ca, sa, cb, sb, cc, sc = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    zero, one = F.lit(0.0), F.lit(1.0)
    return _matrix([
        [cb * cc, -cb * sc, sb, x],
        [sa * sb * cc + ca * sc, ca * cc - sa * sb * sc, -sa * cb, y],
        [sa * sc - ca * sb * cc, ca * sb * sc + sa * cc, ca * cb, z],
        [zero, zero, zero, one],
    ])


def _vector(pose: Column) -> Column:
    roll = F.atan2(-_entry(pose, 1, 2), _entry(pose, 2, 2))
    first = F.when(roll < 0, roll + F.pi()).otherwise(roll)
    across = F.sqrt(_entry(pose, 0, 0) ** 2 + _entry(pose, 0, 1) ** 2)
    pitch = F.atan2(_entry(pose, 0, 2), F.when(roll < 0, -across).otherwise(across))
    s, c = F.sin(first), F.cos(first)
    yaw = F.atan2(c * _entry(pose, 1, 0) + s * _entry(pose, 2, 0), c * _entry(pose, 1, 1) + s * _entry(pose, 2, 1))
    return F.struct(*(_entry(pose, k, 3).alias(n) for k, n in enumerate("xyz")), first.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"))


def to_vector(pose: Column) -> Column:
    """(x, y, z, roll, pitch, yaw) with the first angle in [0, pi]."""
    return _let(pose, _vector)


def transform(pose: Column, x: Column, y: Column, z: Column) -> Column:
    """struct(x, y, z) of a point moved by the pose."""
    return F.struct(*((_entry(pose, r, 0) * x + _entry(pose, r, 1) * y + _entry(pose, r, 2) * z + _entry(pose, r, 3)).alias(n) for r, n in enumerate("xyz")))
